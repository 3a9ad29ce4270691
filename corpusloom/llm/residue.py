"""Template residue: unfilled placeholders, filler text, error pages and script notices.

Two detectors work side by side.

* Slots. Placeholders, and values that a template prints in place of a missing one, are looked for in running text,
  that is outside code spans and code blocks, by their notation, whatever name stands in them. One is enough.
* Messages. Texts are cut into segments (lines, sentences) and the distinct ones, codes being wildcards, go down a prefix
  tree of fixed depth (number of tokens, first tokens). In a leaf a message joins the most similar template, which gets a
  wildcard wherever the two differ, or begins one. Each template is classified once, by evidence of the corpus beside one
  weak feature, what its words say (``wording``):

  1. filler of made-up words: a message without function words, of words that hardly ever stand beside one elsewhere;
  2. company: over the segments of a template that stand with others, the mean share of residue among the others. A
     template that says residue but keeps the company of content quotes or explains, and is content. One that says
     nothing known but keeps the company of residue is residue. The second is asked twice, the first before and after.

  Verdicts go back to the documents: a case is one whose segments are all residue, or neutral (navigation, labels with
  codes), at least one being residue.

The distinct messages of a leaf are mined in one pass; where adaptive execution splits a hot leaf, its parts are mined
apart and templates with the same text are one template, so all further figures are sums. Documents are joined to
templates as narrow rows (document, message id); nothing is collected and nothing is left out for its length.

Defined cases: null, empty and blank texts are no cases, and neither are texts of navigation, codes and odd characters
only. Documents that stand twice are judged together and come out once. Rows without a doc_id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import wording
from corpusloom.sources.shared import written

TAGS = r"(?i)</?(?:html|body|head|title|h\d|p|div|span|noscript|b|i|br|ul|li|a)\b[^>]*>"
CODE = r"(?s)```.*?```|`[^`\n]*`|(?m:^(?: {4}|\t).*$)"
NAME = r"[\p{L}_][\p{L}\p{N}_.]*"
#: Anything between marks that no ordinary writing has; a letter first, so that sets and formulas aren't meant.
BODY = r"\s*[\p{L}_][^{}\[\]<>\r\n]*"
#: Elements in capitals and names of keys, which stand in angle brackets without being placeholders.
NOT_SLOTS = r"(?!(?:HTML|BODY|HEAD|TITLE|TABLE|THEAD|TBODY|SPAN|STRONG|SCRIPT|STYLE|FORM|INPUT|BUTTON|FRAME|IFRAME|CENTER|FONT|IMAGE|VIDEO|AUDIO|SELECT|OPTION|LABEL|NOSCRIPT|ENTER|SHIFT|SPACE|ESCAPE|RETURN|DELETE|CTRL|HOME|BACKSPACE|MASK)\b)"
SLOTS = [
    rf"\{{\{{\{{?[#/^&>=!~-]?{BODY}\}}\}}",
    rf"[$#]\{{{BODY}\}}",
    rf"<%[=-]?{BODY}%>",
    rf"\{{%{BODY}%\}}",
    rf"\[\[\s*{NAME}\s*\]\]",
    rf"<<\s*{NAME}\s*>>",
    rf"@@{NAME}@@",
    rf"&lt;\s*{NAME}\s*&gt;",
    rf"«{NAME}»",
    rf"\{{(?:{NAME}|\d+)\}}",
    r"%[A-Z][A-Z0-9_]*%",
    r"\$[A-Z][A-Z0-9_]*\$",
    r"(?<!\w)__[A-Z][A-Z0-9_]*__",
    r"%\(\w+\)s",
    r"(?<![\w%])%[sd](?!\w)",
    r"[\[<][A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+[\]>]",
    rf"<{NOT_SLOTS}[A-Z]{{5,}}>",
    r"\[(?:INSERT|[Ii]nsert|ENTER|[Ee]nter|YOUR|[Yy]our) [^\]\r\n]+\](?!\()",
    r"<(?:INSERT|[Ii]nsert|ENTER|[Ee]nter|YOUR|[Yy]our) [^>\r\n]+>",
    r"\((?:INSERT|[Ii]nsert|ENTER|[Ee]nter) [^)\r\n]+\)",
    r"\[[^\[\]\r\n]+ TB[DA]\]",
    r"(?<![\]!])\[\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+\](?![(\[:])",
]
#: Values printed in place of a missing one, by a word that they hold.
PRINTED = {
    "[object Object]": r"\[object Object\]",
    "null null": r"\bnull null\b",
    # not where the word is an adjective or a predicate of prose
    "undefined": r"(?<!\b(?:[Aa]n|is|are|was|were|be|or|and|as|of|remains?|returns?|gives?) )\bundefined\b(?=\s*(?:[^\p{L}\s]|$|(?:for|is|was|has|have|had|to|in|on|at|with|and|or|by|from|of|ist|wurde|hat|für|im|a|est|été|pour|es|fue|para|en|il|al)\b))",
    "NaN": r"(?<!\b(?:[Aa]|[Aa]n|is|are|be|or|as|returns?|gives?) )\bNaN\b(?! (?:\p{Ll}+ (?:sort|are|is|count|come|stay)|scores?|values?))",
}
#: One test of the character at hand before the alternatives are tried.
SLOT = r"(?=[{\[<(%$#@«&_])(?:" + "|".join(SLOTS) + ")"

#: Levels of the prefix tree below the number of tokens.
DEPTH = 2
#: The share of places at which a message must agree with a template to join it.
SIMILARITY = 0.6
#: Company above which a template that says nothing known is residue, and below which one that says residue is content.
IS_RESIDUE, IS_CONTENT = 0.5, 0.2
#: The share of its words that stand beside function words elsewhere, up to which a message is made up.
ATTESTED = 0.3

OPEN, RESIDUE, NEUTRAL, MADE_UP = 0, 1, 2, 3
_LABEL = {wording.OPEN: OPEN, wording.RESIDUE: RESIDUE, wording.NEUTRAL: NEUTRAL, wording.MADE_UP: MADE_UP}
ANY = "<*>"


def has_open_slot(text: Column) -> Column:
    """Whether running text (outside code) holds a placeholder. Code is set aside only where the whole text has one."""
    def holds(t: Column) -> Column:
        return reduce(Column.__or__, (F.contains(t, F.lit(word)) & t.rlike(shape) for word, shape in PRINTED.items()), t.rlike(SLOT))

    # a condition, so that code is only looked for where it matters
    return F.coalesce(F.when(holds(text), holds(F.regexp_replace(text, CODE, " "))), F.lit(False))


def segments(documents: DataFrame) -> DataFrame:
    """(doc_id, message) of every segment: its words, with codes and numbers as wildcards, in lower case."""
    text = F.col("text")
    bare = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, TAGS, "\n")).otherwise(text)
    # codes and numbers are wildcards, but for what may be the status of a response
    masked = F.lower(F.regexp_replace(bare, r"\b(?![45]\d\d\b(?![.\d:-]))(?=[\p{L}_]*\d)[\w.:-]*\w", "*"))
    for stop in "。！？":
        masked = F.replace(masked, F.lit(stop), F.lit(stop + "\n"))
    # cut at a blank: the end of a line, the end of a sentence, or more than one blank
    cut = F.split(masked, r"[\s\u0085\u2028\u2029](?:[\s\u0085\u2028\u2029]+|(?<=[\r\n\u0085\u2028\u2029])|(?<=[.!?…].))")
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", F.explode(cut).alias("s"))
    s = F.col("s")
    # short items between separators are navigation
    listed = reduce(Column.__or__, (F.contains(s, F.lit(f" {c} ")) for c in "|·•»>"))
    rows = rows.withColumn("s", F.when(listed, F.regexp_replace(s, r"(?:\S+(?: \S+)? +[|·•»>] +)+\S+", " ")).otherwise(s))
    return rows.select("doc_id", F.rtrim(F.ltrim(s, F.lit(" \t\n\r·|>*#-")), F.lit(" \t\n\r·|>-")).alias("message")).where(F.length("message") > 0)


class Leaf:
    """Templates of one leaf of the prefix tree: lists of tokens, wildcards where their messages differ."""

    def __init__(self):
        self.groups: list[list] = []  # [tokens, number of wildcards, members]

    def add(self, tokens: list[str], member) -> None:
        best, most = None, 0
        for g in self.groups:
            same = sum(map(eq, g[0], tokens))
            if same > most:
                best, most = g, same
        # a wildcard agrees with anything, but half of the places at least must agree as words
        if best is not None and (most + best[1]) >= SIMILARITY * len(tokens) and 2 * most >= len(tokens):
            at = best[0]
            for i, t in enumerate(tokens):
                if at[i] != t and at[i] != ANY:
                    at[i] = ANY
                    best[1] += 1
            best[2].append(member)
        else:
            self.groups.append([list(tokens), 0, [member]])


MINED = "mid long, n long, template string, label int, words array<string>, word string, plain long, total long"
_SCHEMA = pa.schema([("mid", pa.int64()), ("n", pa.int64()), ("template", pa.string()), ("label", pa.int32()), ("words", pa.list_(pa.string())), ("word", pa.string()), ("plain", pa.int64()), ("total", pa.int64())])
_BLOCK = 20_000


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    counts: dict[str, list[int]] = {}
    leaf_id, leaf = None, Leaf()

    def close():
        for tokens, _, members in leaf.groups:
            votes = [0, 0, 0, 0]
            for _, n, label, _ in members:
                votes[label] += n
            label = votes.index(max(votes))
            template = " ".join(tokens)
            for mid, n, own, words in members:
                out.append((mid, n, template, own if MADE_UP in (own, label) else label, words if own == MADE_UP else None, None, None, None))

    def blocks(last: bool):
        while len(out) >= _BLOCK or (last and out):
            part, out[:] = out[:_BLOCK], out[_BLOCK:]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), _SCHEMA.types)], schema=_SCHEMA)

    for batch in batches:
        for at, mid, n, message in zip(*(c.to_pylist() for c in batch.columns)):
            if at != leaf_id:
                close()
                leaf_id, leaf = at, Leaf()
                yield from blocks(False)
            words = wording.WORD.findall(message)
            label, made_up = wording.judge(message, words)
            leaf.add(message.split(), (mid, n, _LABEL[label], made_up))
            words = set(words)
            plain = not words.isdisjoint(wording.FUNCTION_WORDS)
            for w in words:
                c = counts.get(w)
                if c is None:
                    counts[w] = c = [0, 0]
                c[0] += plain
                c[1] += 1
            if len(counts) > 1 << 18:  # word counts are sums, so they can be passed on in parts
                out.extend((None, None, None, None, None, wording.fold(w), p, t) for w, (p, t) in counts.items())
                counts.clear()
    close()
    out.extend((None, None, None, None, None, wording.fold(w), p, t) for w, (p, t) in counts.items())
    yield from blocks(True)


def mine_templates(cut: DataFrame) -> DataFrame:
    """(mid, n, template, label, words) of each distinct message, and (word, plain, total) of each word beside them.

    label is what the template says: 0 nothing known, 1 residue, 2 neutral, 3 perhaps made up, decided by the segments of
    all its messages. plain: the messages that hold the word and a function word.
    """
    distinct = cut.groupBy("message").agg(F.count("*").alias("n"))
    tokens = F.split("message", r"\s+")
    path = [F.size(tokens), *(F.get(tokens, F.lit(i)) for i in range(DEPTH))]
    rows = distinct.select(F.xxhash64(*path).alias("leaf"), F.xxhash64("message").alias("mid"), "n", "message")
    return rows.hint("rebalance", "leaf").sortWithinPartitions("leaf").mapInArrow(_mine, MINED)


def _labels(mined: DataFrame) -> DataFrame:
    """(mid, tid, n, label), messages of made-up words being decided."""
    rows = mined.where("mid is not null").select("mid", F.xxhash64("template").alias("tid"), "n", "label", "words")
    known = mined.where("word is not null").groupBy("word").agg((F.sum("plain") / F.sum("total")).alias("beside"))
    maybe = rows.where(F.col("label") == MADE_UP).select("mid", F.explode("words").alias("word"))
    attested = maybe.join(known, "word").groupBy("mid").agg(F.avg(F.when(F.col("beside") >= ATTESTED, 1.0).otherwise(0.0)).alias("share"))
    decided = attested.select("mid", F.when(F.col("share") <= ATTESTED, F.lit(RESIDUE)).otherwise(F.lit(OPEN)).alias("decided"))
    out = rows.drop("words").join(decided, "mid", "left")
    return out.select("mid", "tid", "n", F.coalesce("decided", F.when(F.col("label") != MADE_UP, F.col("label")), F.lit(OPEN)).alias("label"))


def _company(near: DataFrame, alone: DataFrame, totals: DataFrame) -> DataFrame:
    """(tid, placed, company): segments that stand with others, and the mean share of residue among these others.

    near: (doc_id, tid, own, is_residue), one row for each template of each document that has any residue.
    """
    docs = near.groupBy("doc_id").agg(F.sum("own").alias("all"), F.sum(F.col("own") * F.col("is_residue").cast("long")).alias("bad"))
    rows = near.join(docs, "doc_id")
    others = F.col("all") - F.col("own")
    share = (F.col("bad") - F.col("own") * F.col("is_residue").cast("long")) / others
    sums = rows.groupBy("tid").agg(F.sum(F.when(others > 0, share * F.col("own"))).alias("sum"), F.sum(F.when(others == 0, F.col("own")).otherwise(0)).alias("single"))
    placed = F.col("n") - F.col("single") - F.coalesce("apart", F.lit(0))
    out = sums.join(totals, "tid").join(alone, "tid", "left").select("tid", placed.alias("placed"), "sum")
    return out.select("tid", "placed", F.when(F.col("placed") > 0, F.coalesce("sum", F.lit(0.0)) / F.col("placed")).alias("company"))


def classify(marked: DataFrame, totals: DataFrame) -> DataFrame:
    """(tid, says, company, residue) of the templates that stand in a document with residue wording.

    marked: (doc_id, tid, label) of each segment that isn't neutral; totals: (tid, n) segments of each template.
    """
    says = F.col("label") == RESIDUE
    docs = marked.groupBy("doc_id").agg(F.count(F.when(says, 1)).alias("hits"), F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.count("*").alias("n"))
    alone = docs.where("hits = 0 and lo = hi").groupBy(F.col("lo").alias("tid")).agg(F.sum("n").alias("apart"))
    near = marked.join(docs.where("hits > 0").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", "tid").agg(F.count("*").alias("own"), F.max(says).alias("says"))
    near, alone = written(near.withColumn("is_residue", F.col("says")), "near"), written(alone, "alone")
    totals = totals.join(near.select("tid"), "tid", "left_semi")
    content = (F.col("company") < IS_CONTENT) & (F.col("placed") >= 2)
    joins = F.coalesce(F.col("company") >= IS_RESIDUE, F.lit(False))
    # first what plainly keeps the company of content, then, twice, what keeps that of residue
    for verdict in (F.col("says") & ~F.coalesce(content, F.lit(False)), F.col("is_residue") | (~F.col("says") & joins)):
        new = _company(near, alone, totals)
        near = written(near.join(new, "tid").withColumn("is_residue", verdict).drop("company", "placed"), "near")
    last = near.groupBy("tid").agg(F.max("says").alias("says"), F.max("is_residue").alias("was")).join(_company(near, alone, totals), "tid")
    keeps = F.coalesce(F.col("company") >= IS_CONTENT, F.lit(True))
    return last.select("tid", "says", "company", F.when(F.col("was"), keeps).otherwise(~F.col("says") & joins).alias("residue"))


def _mark(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mined templates, (doc_id, tid, label) of all segments that aren't neutral, and (tid, n)."""
    cut = written(segments(documents), "segments")
    mined = written(mine_templates(cut), "mined")
    labels = written(_labels(mined), "labels")
    places = cut.select("doc_id", F.xxhash64("message").alias("mid"))
    marked = written(places.join(labels.where(F.col("label") != NEUTRAL).select("mid", "tid", "label"), "mid").drop("mid"), "marked")
    return mined, marked, labels.groupBy("tid").agg(F.sum("n").alias("n"))


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents to leave out."""
    slots = documents.where(F.col("doc_id").isNotNull() & has_open_slot(F.col("text"))).select("doc_id")
    _, marked, totals = _mark(documents)
    verdicts = classify(marked, totals).where("residue").select("tid", F.lit(1).alias("hit"))
    pages = marked.select("doc_id", "tid").join(verdicts, "tid", "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("hit").alias("r")).where("n = r")
    return slots.unionByName(pages.select("doc_id")).distinct()


def templates(documents: DataFrame) -> DataFrame:
    """(template, segments, says, company, residue) of every mined template; company is null where it wasn't asked for."""
    mined, marked, totals = _mark(documents)
    names = mined.where("mid is not null").select(F.xxhash64("template").alias("tid"), "template").distinct()
    judged = classify(marked, totals)
    rows = names.join(totals, "tid").join(judged, "tid", "left")
    return rows.select("template", F.col("n").alias("segments"), F.coalesce("says", F.lit(False)).alias("says"), "company", F.coalesce("residue", F.lit(False)).alias("residue"))


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that aren't residue, with all their columns; rows without a doc_id stay."""
    return documents.join(residue_documents(documents), "doc_id", "left_anti")
