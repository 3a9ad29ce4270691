"""Queries that show text analysis, one operator each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import analysis as an
from corpusloom.functions import stemming
from corpusloom.functions.languages import ENDINGS, STOP_BY_LANGUAGE, language_analyser
from corpusloom.plans.registry import Registry, table

_W = "regexp_extract_all(coalesce({0}, ''), '[\\p{{L}}\\p{{Nd}}]+')"
_WORDS = _W.format("title")
#: Their SQL builds the words of a text again for each of its words, so over texts they are tested on a fixture.
_SLOW = {"filter_shingle", "filter_common_grams"}
_COMMON = ["plain", "ledger", "query", "nested"]


def _counted(tokens: str, source: str = "documents") -> str:
    return f"SELECT term, count(*) AS n FROM (SELECT unnest({tokens}) AS term FROM {source}) GROUP BY term"


def _by_term(term: str, tokens: str, keep: str = "TRUE") -> str:
    """Counts after a change of each distinct term t of the texts' tokens; terms for which keep doesn't hold are left out."""
    return (
        f"WITH raw AS (SELECT t, count(*) AS n FROM (SELECT unnest({tokens}) AS t FROM documents) GROUP BY t) "
        f"SELECT term, sum(n)::BIGINT AS n FROM (SELECT {term} AS term, n FROM raw WHERE {keep}) GROUP BY term"
    )


def _shingle_counts(tokens: Column, most: int) -> Callable[[DataFrame], DataFrame]:
    """Counts of shingles of 1 to most tokens, which hold no space.

    Windows of most tokens are counted first. That settles the longest shingles; the shorter ones are beginnings of
    distinct windows. Both read one shuffle: an explosion stays above the aggregation, where a filter would move below it.
    """

    def count(rows: DataFrame) -> DataFrame:
        found = rows.select(F.explode(an.windows(most)(tokens)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        parts = F.split("w", " ")
        full = F.filter(F.array("w"), lambda w: F.size(F.split(w, " ")) == most)
        begun = an.once(parts, lambda p: F.transform(F.sequence(F.lit(1), F.least(F.size(p), F.lit(most - 1))), lambda i: F.array_join(F.slice(p, F.lit(1), i), " ")))
        shorter = found.select(F.explode(begun).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n"))
        return found.select(F.explode(full).alias("term"), "n").unionByName(shorter)

    return count


def _gram_counts(text: Column, lo: int, hi: int) -> Callable[[DataFrame], DataFrame]:
    """Counts of character grams. Pieces of texts are counted first, which are fewer and repeat; only distinct ones are cut into grams."""

    def count(rows: DataFrame) -> DataFrame:
        pieces = rows.select(F.inline(an.gram_pieces(hi)(text))).groupBy("piece", "starts").agg(F.count("*").alias("n"))
        return pieces.select(F.explode(an.piece_grams(F.col("piece"), F.col("starts"), lo, hi)).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n"))

    return count


def _suffixes_sql(word: str, steps, guard: int, fold=None, drop_last: str = "", drop_above: int = 2, shortest: int = 3) -> str:
    """A suffix stemmer in SQL: in each step the first ending of the list that fits is replaced."""
    out = word
    for a, b in (fold or {}).items():
        out = f"replace({out}, '{a}', '{b}')"
    for rules in steps:
        # a CASE for each step: the order of the list is the order of the tests
        tests = " ".join(f"WHEN regexp_matches(w, '^.{{{guard},}}{a}$') THEN left(w, length(w) - {len(a)}) || '{b}'" for a, b in rules)
        out = f"list_transform([{out}], lambda w: CASE {tests} ELSE w END)[1]"
    if drop_last:
        out = f"regexp_replace({out}, '^(.{{{drop_above},}}){drop_last}$', '\\1')"
    return f"CASE WHEN length({word}) <= {shortest} THEN {word} ELSE {out} END"


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_TEXT_WORDS = _W.format("text")
_ICU = "[\\p{L}\\p{N}\\p{M}]+(?:[''’_-][\\p{L}\\p{N}\\p{M}]+)*"
_ARABIC_SQL = (
    "CASE WHEN length(t) <= 2 THEN t ELSE regexp_replace(regexp_replace(regexp_replace(t, '^(?:وال|بال|كال|فال|ال)(.{3,})$', '\\1'), '^(?:و|ف|ب|ل|ك|س)(.{3,})$', '\\1'), "
    "'^(.{2,}?)(?:تين|ين|ون|ات|ان|تا|ية|يا|ها|هم|هن|كم|نا|ني|تم|تن|ة|ت|ي|ا)$', '\\1') END"
)


def _language_sql(code: str) -> str | None:
    low = f"list_transform({_TEXT_WORDS}, lambda x: lower(x))"
    keep = f"NOT list_contains({_quoted(STOP_BY_LANGUAGE[code])}, lower(t))"
    stems = {
        "fr": lambda: _suffixes_sql("t", an.FRENCH, 2, drop_last="e"),
        "de": lambda: _suffixes_sql("t", an.GERMAN, 3, fold={"ä": "a", "ö": "o", "ü": "u", "ß": "ss"}),
        "ar": lambda: _ARABIC_SQL,
        **{c: (lambda c=c: _suffixes_sql("t", [an.ending_rules(x) for x in ENDINGS[c]], 3)) for c in ("es", "it", "pt")},
        "nl": lambda: _suffixes_sql("t", [an.ending_rules(x) for x in ENDINGS["nl"]], 3, drop_last="e", drop_above=3),
        "ru": lambda: _suffixes_sql("t", [an.ending_rules(x) for x in ENDINGS["ru"]], 2, shortest=2),
    }
    return _by_term(stems[code](), low, keep) if code in stems else None


def register(reg: Registry) -> None:
    """Add this module's queries."""

    def add(name, analyse, tokens, column="title", source=None, counts=None):
        """Terms of a column with their counts; counts makes them of rows and the column if terms are too many to be exploded."""

        def run(s, d):
            rows = table(s, d, "documents") if source is None else source(table(s, d, "documents"))
            if counts is not None:
                return counts(F.coalesce(F.col(column), F.lit("")))(rows)
            return rows.select(F.explode(analyse(F.coalesce(F.col(column), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))

        if column == "title" or name == "tok_ngram":  # the same over whole texts
            add(f"{name}_text", analyse, None if tokens is None or name in _SLOW else tokens.replace(column, "text").replace("\\S+", "[^\\s\\x0b]+"), "text", counts=counts)
        reg.add(name, run, None if tokens is None else _counted(tokens) if tokens.strip().startswith(("list", "regexp", "string", "flatten", "[", "CASE")) else tokens)

    low = f"list_transform({_WORDS}, lambda x: lower(x))"
    add("tok_words", an.words, _WORDS)
    add("tok_letters", an.letters, "regexp_extract_all(coalesce(title, ''), '\\p{L}+')")
    add("tok_whitespace", an.whitespace, "regexp_extract_all(coalesce(title, ''), '\\S+')")
    add("tok_keyword", an.keyword, "[coalesce(source, '')]", "source")
    add("tok_pattern", an.by_pattern(r"[a-z]{3}"), "regexp_extract_all(coalesce(title, ''), '[a-z]{3}')")
    add("tok_ngram", an.ngrams(2, 3), "flatten(list_transform(range(1, length(coalesce(source, '')) + 1), lambda i: list_transform(list_filter([2, 3], lambda n: i + n - 1 <= length(source)), lambda n: substr(source, i, n))))", "source", counts=lambda text: _gram_counts(text, 2, 3))
    add("tok_edge_ngram", an.edge_ngrams(2, 4), "flatten(list_transform(regexp_extract_all(coalesce(title, ''), '\\S+'), lambda w: list_transform(list_filter([2, 3, 4], lambda n: n <= length(w)), lambda n: substr(w, 1, n))))")
    path = "replace(coalesce(source, ''), '_', '/')"
    parts = f"string_split({path}, '/')"
    paths = lambda rows: rows.withColumn("path", F.replace("source", F.lit("_"), F.lit("/")))
    add("tok_path", an.path_tree(), f"list_filter(list_transform(range(1, len({parts}) + 1), lambda i: array_to_string({parts}[1:i], '/')), lambda x: x <> '')", "path", paths)
    add("tok_path_suffix", an.path_tree(reverse=True), f"list_filter(list_transform(range(1, len({parts}) + 1), lambda i: array_to_string({parts}[i:], '/')), lambda x: x <> '')", "path", paths)
    url = "https?://[^\\s\\x0b<>\"]+|www\\.[^\\s\\x0b<>\"]+|[\\p{L}\\p{N}._%+-]+@[\\p{L}\\p{N}-]+(?:\\.[\\p{L}\\p{N}-]+)+|[#@][\\p{L}\\p{N}_]+|"
    add("tok_url", an.url_email, f"regexp_extract_all(coalesce(text, ''), '{url}{_ICU}')", "text")
    add("tok_icu", an.icu_words, f"regexp_extract_all(coalesce(text, ''), '{_ICU}')", "text")
    add("char_pattern", lambda c: an.words(an.replace_pattern(c, "[0-9]+", "#n")), "regexp_extract_all(regexp_replace(coalesce(text, ''), '[0-9]+', '#n', 'g'), '[\\p{L}\\p{Nd}]+')", "text")
    marked = frozenset(["ledger", "queries", "nested"])
    cut = lambda t: F.regexp_replace(t, "(?:ies|es|s)$", "")
    add("filter_marked", an.analyser(an.words, an.lowercase, an.each_but(sorted(marked), cut)), _by_term(f"CASE WHEN list_contains({_quoted(sorted(marked))}, t) THEN t ELSE regexp_replace(t, '(?:ies|es|s)$', '') END", f"list_transform({_TEXT_WORDS}, lambda x: lower(x))"), "text")
    add("tok_cjk", an.cjk_bigrams, None, "text")
    add("analyse_standard", an.standard, f"list_filter({low}, lambda x: NOT list_contains({an.STOP_WORDS}, x))")
    add("analyse_simple", an.simple, "list_transform(regexp_extract_all(coalesce(title, ''), '\\p{L}+'), lambda x: lower(x))")
    add("filter_lowercase", an.analyser(an.words, an.lowercase), low)
    add("filter_keep", an.analyser(an.words, an.lowercase, an.keep(_COMMON)), f"list_filter({low}, lambda x: list_contains({_COMMON}, x))")
    add("filter_length", an.analyser(an.words, an.length_between(4, 6)), f"list_filter({_WORDS}, lambda x: length(x) BETWEEN 4 AND 6)")
    add("filter_truncate", an.analyser(an.words, an.truncate(3)), f"list_transform({_WORDS}, lambda x: left(x, 3))")
    add("filter_limit", an.analyser(an.words, an.limit(2)), f"list_slice({_WORDS}, 1, 2)")
    add("filter_reverse", an.analyser(an.words, an.reverse), f"list_transform({_WORDS}, lambda x: reverse(x))")
    add("filter_type_number", an.analyser(an.words, an.of_type(["number"])), "list_filter(" + _W.format("text") + ", lambda x: regexp_full_match(x, '\\p{Nd}+'))", "text")
    add("filter_pattern", an.analyser(an.words, an.replace_in_tokens("[aeiou]+", "*")), f"list_transform({_WORDS}, lambda x: regexp_replace(x, '[aeiou]+', '*', 'g'))")
    add("filter_accent_fold", an.analyser(an.words, an.fold_accents), f"list_transform({_WORDS}, lambda x: strip_accents(x))")
    add("filter_decimal_digits", an.analyser(an.words, an.of_type(["number"]), an.decimal_digits), "list_transform(list_filter(" + _TEXT_WORDS + ", lambda x: regexp_full_match(x, '\\p{Nd}+')), lambda x: translate(x, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९০১২৩৪৫৬৭৮৯๐๑๒๓๔๕๖๗๘๙０１２３４５６７８９', '012345678901234567890123456789012345678901234567890123456789'))", "text")
    add("filter_elision", an.analyser(an.whitespace, an.elision()), "list_transform(regexp_extract_all(coalesce(text, ''), '[^\\s\\x0b]+'), lambda x: regexp_replace(x, '^(?i:" + "|".join(an.ARTICLES) + ")[''’](.)', '\\1'))", "text")
    add("filter_classic", an.analyser(an.whitespace, an.classic), "list_transform(list_transform(regexp_extract_all(coalesce(text, ''), '[^\\s\\x0b]+'), lambda x: regexp_replace(x, '(?:[''’][sS]|[''’])$', '')), lambda b: CASE WHEN regexp_full_match(b, '(?:\\p{L}\\.)+\\p{L}?') AND length(b) >= 2 THEN replace(b, '.', '') ELSE b END)", "text")
    add("filter_shingle", an.analyser(an.words, an.lowercase, an.shingles(2, 3)), f"list_concat({low}, list_concat(list_transform(range(1, len({low})), lambda i: array_to_string({low}[i:i+1], ' ')), list_transform(range(1, greatest(len({low}) - 1, 1)), lambda i: array_to_string({low}[i:i+2], ' '))))",
        counts=lambda text: _shingle_counts(an.analyser(an.words, an.lowercase)(text), 3))
    pairs = f"list_transform(list_filter(range(1, len({low})), lambda i: list_contains({_COMMON}, {low}[i]) AND list_contains({_COMMON}, {low}[i+1])), lambda i: concat({low}[i], '_', {low}[i+1]))"
    add("filter_common_grams", an.analyser(an.words, an.lowercase, an.common_grams(_COMMON)), f"list_concat({low}, {pairs})")
    add("filter_synonyms", an.analyser(an.words, an.lowercase, an.synonyms({"ledger": ["book", "register"], "plain": ["simple"]})),
        f"list_concat({low}, flatten(list_transform({low}, lambda x: CASE x WHEN 'ledger' THEN ['book', 'register'] WHEN 'plain' THEN ['simple'] ELSE [] END)))")
    add("filter_word_delimiter", an.analyser(an.whitespace, an.word_delimiter()), None, "text")
    add("filter_hyphenated", an.analyser(an.whitespace, an.rejoin_hyphenated), None, "text")
    add("filter_unique", an.analyser(an.words, an.unique), f"list_distinct({_WORDS})")
    add("html_strip", lambda c: an.words(an.strip_html(c)), "regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>?', ' ', 'g'), '&[A-Za-z0-9_]*;', ' ', 'g'), '[\\p{L}\\p{Nd}]+')", "text")
    add("map_characters", lambda c: an.words(an.map_characters(c, {"ä": "ae", "ß": "ss"})), "regexp_extract_all(replace(replace(coalesce(text, ''), 'ä', 'ae'), 'ß', 'ss'), '[\\p{L}\\p{Nd}]+')", "text")
    low_text = f"list_transform({_TEXT_WORDS}, lambda x: lower(x))"
    add("stem_fr", an.analyser(an.words, an.lowercase, an.each(an.stem_french)), _by_term(_suffixes_sql("t", an.FRENCH, 2, drop_last="e"), low_text), "text")
    add("stem_de", an.analyser(an.words, an.lowercase, an.each(an.stem_german)), _by_term(_suffixes_sql("t", an.GERMAN, 3, fold={"ä": "a", "ö": "o", "ü": "u", "ß": "ss"}), low_text), "text")
    for code in STOP_BY_LANGUAGE:
        add(f"analyse_{code}", language_analyser(code), _language_sql(code), "text")

    def stems(s, d, fn=stemming.porter):
        terms = table(s, d, "documents").select(F.explode(an.standard(F.col("text"))).alias("term"))
        return stemming.on_distinct_terms(terms, "term", fn)

    reg.add("stem_porter", stems)
    reg.add("phonetic_metaphone", lambda s, d: stems(s, d, stemming.metaphone))
    reg.add("token_budget", lambda s, d: _budget(table(s, d, "documents")), "SELECT doc_id, len(list_slice(" + _W.format("text") + ", 1, 50)) AS n FROM documents WHERE text IS NOT NULL")


def _budget(documents):
    from corpusloom.sources.schema import token_budget

    return documents.where("text is not null").select("doc_id", F.size(token_budget(an.words(F.col("text")), 50)).cast("long").alias("n"))
