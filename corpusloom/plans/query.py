"""Query algebra and its compilation to DataFrames.

A query tree compiles to one scan, one shuffle and two expressions. Every leaf that looks at terms registers an atom
(a predicate on postings). The postings that any atom wants are read once (the predicates are pushed to the Parquet
scan), joined to the term statistics if scores are needed, and grouped by document; each atom becomes a few columns of
that aggregation (occurrences, score, positions). Match and score of the whole tree are then expressions over one row
for each document, whatever the depth of the tree: conjunction, disjunction and exclusion need no further joins.
Leaves that look at stored columns are expressions over the documents table, which is joined only if one is there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import similarity as sim
from corpusloom.sources.index import Index

Similarity = Callable[[sim.Stats], Column]
ZERO, FALSE = 0.0, False


@dataclass
class Atom:
    """Postings of one field whose term satisfies a predicate."""

    field: str
    wants: Callable[[Column], Column]
    weight: Callable[[Column], Column] | None = None
    scored: bool = False
    positions: bool = False
    #: The predicate is a pattern: it is put to the terms, not to each of their postings.
    pattern: bool = False


class Plan:
    """Collects the atoms of a query tree while its expressions are made."""

    def __init__(self, index: Index, similarity: Similarity):
        self.index, self.similarity, self.atoms, self.uses_docs = index, similarity, [], False

    def atom(self, a: Atom) -> str:
        self.atoms.append(a)
        return str(len(self.atoms) - 1)

    def hit(self, k: str) -> Column:
        return F.coalesce(F.col(f"tf{k}") > 0, F.lit(False))

    def tf(self, k: str) -> Column:
        return F.coalesce(F.col(f"tf{k}"), F.lit(0)).cast("double")

    def score(self, k: str) -> Column:
        return F.coalesce(F.col(f"score{k}"), F.lit(0.0))

    def positions(self, k: str) -> Column:
        return F.coalesce(F.col(f"pos{k}"), F.array().cast("array<int>"))

    def length(self, name: str) -> Column:
        return F.col(f"dl_{name}").cast("double")

    def stored(self, column: str) -> Column:
        self.uses_docs = True
        return F.col(f"doc.{column}")

    def similar(self, name: str, tf: Column, df: Column, cf: Column, dl: Column | None = None) -> Column:
        s = self.index.field(name)
        return self.similarity(sim.Stats(tf, self.length(name) if dl is None else dl, df.cast("double"), cf.cast("double"), s.n_docs, s.avgdl, s.sum_len))

    def gathered(self) -> DataFrame | None:
        """A row for each document that any atom hits."""
        if not self.atoms:
            return None
        wants = [(F.col("field") == a.field) & a.wants(F.col("term")) for a in self.atoms]
        stats = self.index.term_stats.where(reduce(lambda x, y: x | y, wants))
        if any(a.pattern for a in self.atoms):
            # patterns are put to each term once; postings come by the terms that fit
            fields = F.col("field").isin(*dict.fromkeys(a.field for a in self.atoms))
            terms = stats.select("field", "term", "df", "cf", *[w.alias(f"w{k}") for k, w in enumerate(wants)])
            rows, wants = self.index.postings.where(fields).join(terms, ["field", "term"]), [F.col(f"w{k}") for k in range(len(wants))]
        else:
            rows = self.index.postings.where(reduce(lambda x, y: x | y, wants))
            if any(a.scored for a in self.atoms):
                rows = rows.join(stats, ["field", "term"])
        columns = []
        for k, (a, want) in enumerate(zip(self.atoms, wants)):
            columns.append(F.sum(F.when(want, F.col("tf"))).alias(f"tf{k}"))
            if a.scored:
                value = self.similar(a.field, F.col("tf").cast("double"), F.col("df"), F.col("cf"), F.col("dl").cast("double"))
                columns.append(F.sum(F.when(want, value * a.weight(F.col("term")) if a.weight else value)).alias(f"score{k}"))
            if a.positions:
                columns.append(F.array_sort(F.flatten(F.collect_list(F.when(want, F.col("positions"))))).alias(f"pos{k}"))
        for name in dict.fromkeys(a.field for a in self.atoms):
            columns.append(F.max(F.when(F.col("field") == name, F.col("dl"))).alias(f"dl_{name}"))
        return rows.groupBy("doc_id").agg(*columns)


class Query:
    """Base of all queries. Subclasses give match and score expressions, or a frame of their own."""

    boost: float = 1.0
    #: Whether documents without any wanted posting can match.
    anywhere = False

    def match(self, p: Plan) -> Column:
        raise NotImplementedError

    def score(self, p: Plan) -> Column:
        return F.lit(float(self.boost))

    def spans(self, p: Plan) -> Column:
        raise TypeError(f"{type(self).__name__} has no spans")

    def rewrite(self, index: Index) -> "Query":
        """The same query in simpler terms; called until nothing changes."""
        return self

    def boosted(self, by: float) -> "Query":
        return replace(self, boost=self.boost * by)

    def __and__(self, other: "Query") -> "Query":
        return Bool(must=(self, other))

    def __or__(self, other: "Query") -> "Query":
        return Bool(should=(self, other))

    def __invert__(self) -> "Query":
        return Bool(must=(MatchAll(),), must_not=(self,))


def search(index: Index, query: Query, similarity: str | Similarity = "bm25", scores: bool = True) -> DataFrame:
    """(doc_id, score) of the documents that match, in no order; without scores only doc_id."""
    for _ in range(16):
        simpler = query.rewrite(index)
        if simpler is query:
            break
        query = simpler
    if hasattr(query, "frame"):
        out = query.frame(index, similarity)
        return out if scores else out.select("doc_id")
    p = Plan(index, sim.SIMILARITIES[similarity] if isinstance(similarity, str) else similarity)
    match = query.match(p)
    score = query.score(p) if scores else F.lit(0.0)
    if not scores:
        for a in p.atoms:
            a.scored = False
    rows = p.gathered()
    if query.anywhere or rows is None:
        docs = index.docs.where("doc_id is not null").select("doc_id", F.struct("*").alias("doc"))
        rows = docs if rows is None else docs.join(rows, "doc_id", "left")
    elif p.uses_docs:
        rows = rows.join(index.docs.select("doc_id", F.struct("*").alias("doc")), "doc_id")
    found = rows.where(F.coalesce(match, F.lit(False)))
    return found.select("doc_id", score.cast("double").alias("score")) if scores else found.select("doc_id")


def count(index: Index, query: Query) -> DataFrame:
    """(n): how many documents match; no score is computed."""
    return search(index, query, scores=False).agg(F.count("*").alias("n"))


def top(hits: DataFrame, n: int) -> DataFrame:
    """The n best, score descending, then doc_id."""
    return hits.orderBy(F.desc("score"), "doc_id").limit(n)


# leaves over terms


@dataclass(frozen=True)
class MatchAll(Query):
    boost: float = 1.0
    anywhere = True

    def match(self, p):
        return F.lit(True)


@dataclass(frozen=True)
class MatchNone(Query):
    reason: str = ""
    boost: float = 1.0

    def match(self, p):
        return F.lit(False)


@dataclass(frozen=True)
class _Terms(Query):
    """Scores each matching term by the similarity, with its own document frequency, and adds up."""

    field: str
    boost: float = field(default=1.0, kw_only=True)
    constant = False
    pattern_like = False

    def wants(self, term: Column) -> Column:
        raise NotImplementedError

    def weight(self, term: Column) -> Column | None:
        return None

    def _atom(self, p: Plan, scored: bool, positions: bool = False) -> str:
        weighted = type(self).weight is not _Terms.weight
        return p.atom(Atom(self.field, self.wants, self.weight if weighted else None, scored, positions, self.pattern_like))

    def match(self, p):
        k = self._atom(p, not self.constant)
        object.__setattr__(self, "_k", k)
        return p.hit(k)

    def score(self, p):
        return F.lit(float(self.boost)) if self.constant else p.score(self._k) * float(self.boost)

    def spans(self, p):
        at = p.positions(self._atom(p, False, True))
        return F.transform(at, lambda x: F.struct(x.alias("s"), (x + 1).alias("e")))


@dataclass(frozen=True)
class Term(_Terms):
    term: str

    def wants(self, term):
        return term == self.term


@dataclass(frozen=True)
class TermInSet(_Terms):
    terms: tuple[str, ...]
    constant = True

    def wants(self, term):
        return term.isin(*dict.fromkeys(self.terms))


@dataclass(frozen=True)
class Prefix(_Terms):
    prefix: str

    def wants(self, term):
        return term.startswith(self.prefix)


def glob_pattern(pattern: str) -> str:
    """A regular expression for * and ?."""
    quoted = "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if not c.isalnum() and c.isascii() else c for c in pattern)
    return f"^(?s:{quoted})$"


@dataclass(frozen=True)
class Wildcard(_Terms):
    pattern: str
    pattern_like = True

    def rewrite(self, index):
        if self.pattern.endswith("*") and not set(self.pattern[:-1]) & {"*", "?"}:
            return Prefix(self.field, self.pattern[:-1], boost=self.boost)
        return self

    def wants(self, term):
        cut = min((i for i, c in enumerate(self.pattern) if c in "*?"), default=len(self.pattern))
        fits = term.rlike(glob_pattern(self.pattern))
        return term.startswith(self.pattern[:cut]) & fits if cut else fits  # the literal start is pushed to the scan


def literal_start(pattern: str) -> str:
    """The letters that every match must begin with, if the pattern begins with some; '' if that can't be said."""
    if "|" in pattern:
        return ""
    n = next((i for i, c in enumerate(pattern) if not c.isalnum()), len(pattern))
    return pattern[: n - 1] if n < len(pattern) and pattern[n] in "*?{" else pattern[:n]


@dataclass(frozen=True)
class Regexp(_Terms):
    pattern: str
    pattern_like = True

    def wants(self, term):
        start = literal_start(self.pattern)
        fits = term.rlike(f"^(?:{self.pattern})" if start else self.pattern)
        return term.startswith(start) & fits if start else fits


@dataclass(frozen=True)
class TermRange(_Terms):
    low: str | None
    high: str | None
    include_low: bool = True
    include_high: bool = True

    def wants(self, term):
        out = F.lit(True)
        if self.low is not None:
            out = out & (term >= self.low if self.include_low else term > self.low)
        if self.high is not None:
            out = out & (term <= self.high if self.include_high else term < self.high)
        return out


@dataclass(frozen=True)
class Fuzzy(_Terms):
    """Terms within max_edits, the ``expansions`` closest (ties by term), each weighted by 1 - edits / (max_edits + 1)."""

    term: str
    max_edits: int = 2
    expansions: int = 64

    def rewrite(self, index):
        edits = F.levenshtein(F.col("term"), F.lit(self.term), self.max_edits)
        near = index.term_stats.where(F.col("field") == self.field).withColumn("d", edits).where("d >= 0")
        terms = tuple(r.term for r in near.orderBy("d", "term").limit(self.expansions).collect())
        return _Expanded(self.field, self.term, self.max_edits, terms, boost=self.boost) if terms else MatchNone("no near term")


@dataclass(frozen=True)
class _Expanded(_Terms):
    term: str
    max_edits: int
    terms: tuple[str, ...]

    def wants(self, term):
        return term.isin(*self.terms)

    def weight(self, term):
        return 1 - F.levenshtein(term, F.lit(self.term)) / float(self.max_edits + 1)


@dataclass(frozen=True)
class Synonym(Query):
    """Several terms as if they were one: occurrences add up, the document frequency is the greatest."""

    field: str
    terms: tuple[str, ...]
    boost: float = 1.0

    def match(self, p):
        k = p.atom(Atom(self.field, lambda t: t.isin(*self.terms)))
        object.__setattr__(self, "_k", k)
        return p.hit(k)

    def score(self, p):
        info = p.index.term_info(self.field, list(self.terms))
        df, cf = max((d for d, _ in info.values()), default=0), max((c for _, c in info.values()), default=0)
        return p.similar(self.field, p.tf(self._k), F.lit(df), F.lit(cf)) * float(self.boost)


@dataclass(frozen=True)
class CombinedFields(Query):
    """BM25F: each field's occurrences, normalised by its length and weighted, add up before they saturate."""

    fields: tuple[str, ...]
    terms: tuple[str, ...]
    minimum: int = 1
    weights: tuple[float, ...] = ()
    boost: float = 1.0
    k1: float = 1.2
    b: float = 0.75

    def match(self, p):
        ks = {(t, f): p.atom(Atom(f, lambda x, t=t: x == t)) for t in self.terms for f in self.fields}
        object.__setattr__(self, "_ks", ks)
        hits = [reduce(lambda x, y: x | y, [p.hit(ks[t, f]) for f in self.fields]) for t in self.terms]
        return sum((h.cast("int") for h in hits[1:]), hits[0].cast("int")) >= self.minimum

    def score(self, p):
        rows = p.index.postings.where(F.col("field").isin(*self.fields) & F.col("term").isin(*self.terms))
        df = {r.term: r.df for r in rows.groupBy("term").agg(F.countDistinct("doc_id").alias("df")).collect()}  # as many as the query has terms
        n = max(p.index.field(f).n_docs for f in self.fields)
        out = F.lit(0.0)
        for t in self.terms:
            freq = F.lit(0.0)
            for i, f in enumerate(self.fields):
                avgdl = p.index.field(f).avgdl or 1.0
                norm = 1 - self.b + self.b * F.coalesce(p.length(f), F.lit(0.0)) / avgdl
                freq = freq + (self.weights[i] if self.weights else 1.0) * p.tf(self._ks[t, f]) / norm
            d = float(df.get(t, 0))
            idf = F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5)))
            out = out + F.when(freq > 0, idf * (self.k1 + 1) * freq / (freq + self.k1)).otherwise(0.0)
        return out * float(self.boost)


# leaves over stored columns


@dataclass(frozen=True)
class Where(Query):
    """Any predicate on stored columns: ranges, points, sets, geography. Constant score."""

    predicate: Callable[[Callable[[str], Column]], Column]
    boost: float = 1.0
    anywhere = True

    def match(self, p):
        return self.predicate(p.stored)


def exists(column: str, boost: float = 1.0) -> Query:
    return Where(lambda c: c(column).isNotNull(), boost)


def number_range(column: str, low=None, high=None, include_low: bool = True, include_high: bool = True, boost: float = 1.0) -> Query:
    def predicate(c):
        out = c(column).isNotNull()
        if low is not None:
            out = out & (c(column) >= low if include_low else c(column) > low)
        if high is not None:
            out = out & (c(column) <= high if include_high else c(column) < high)
        return out

    return Where(predicate, boost)


def points(column: str, values: Sequence, boost: float = 1.0) -> Query:
    return Where(lambda c: c(column).isin(*values), boost)


def any_value(column: str, test: Callable[[Column], Column], boost: float = 1.0) -> Query:
    """A multi-valued column of which any value passes."""
    return Where(lambda c: F.exists(c(column), test), boost)


def binary_range(column: str, low: bytes | None, high: bytes | None, boost: float = 1.0) -> Query:
    """Unsigned byte order, ends included."""

    def predicate(c):
        out = c(column).isNotNull()
        if low is not None:
            out = out & (c(column) >= F.lit(bytearray(low)))
        return out if high is None else out & (c(column) <= F.lit(bytearray(high)))

    return Where(predicate, boost)


def ipv4_number(address: Column) -> Column:
    """Null for what isn't an IPv4 address."""
    parts = F.split(address, r"\.")
    b = [F.get(parts, F.lit(i)).try_cast("long") for i in range(4)]
    fits = reduce(lambda x, y: x & y, [x.between(0, 255) for x in b], address.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"))
    return F.when(fits, sum((x * 256 ** (2 - i) for i, x in enumerate(b[1:])), b[0] * 256**3))


def ip_key(address: Column) -> Column:
    """An address as 32 hexadecimal digits that sort like it; IPv4 as the IPv4-mapped IPv6 address. Null for anything else."""
    mapped = F.regexp_replace(address, r"(?i)^::ffff:(?=\d+\.)", "")
    v4 = mapped.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    number = ipv4_number(mapped)
    small = F.when(number.isNotNull(), F.concat(F.lit("00000000000000000000ffff"), F.lpad(F.hex(number), 8, "0")))
    # an embedded IPv4 tail is two groups; :: stands for as many zero groups as are missing
    tail = F.split(F.regexp_extract(address, r"(\d+\.\d+\.\d+\.\d+)$", 1), r"\.")
    pair = lambda i: F.concat(F.lpad(F.hex(F.get(tail, F.lit(i)).try_cast("int")), 2, "0"), F.lpad(F.hex(F.get(tail, F.lit(i + 1)).try_cast("int")), 2, "0"))
    plain = F.when(address.rlike(r":\d+\.\d+\.\d+\.\d+$"), F.concat(F.regexp_extract(address, r"^(.*:)\d+\.\d+\.\d+\.\d+$", 1), pair(0), F.lit(":"), pair(2))).otherwise(address)
    halves = F.split(plain, "::")
    groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), F.when(F.size(halves) > 1, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    missing = 8 - F.size(left) - F.size(right)
    whole = F.when(F.size(halves) == 1, missing == 0).otherwise((F.size(halves) == 2) & (missing > 0))
    digits = F.array_join(F.transform(F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right), lambda g: F.lpad(g, 4, "0")), "")
    large = F.when(whole & plain.rlike(r"^[0-9A-Fa-f:]+$") & ~plain.rlike(r"[0-9A-Fa-f]{5}|:::"), F.lower(digits))
    return F.lower(F.when(v4, small).when(address.contains(":"), large))


def ip_range(column: str, low: str, high: str, boost: float = 1.0) -> Query:
    """Addresses from low to high, ends included; values that aren't addresses never match."""
    if ":" not in low + high:  # IPv6 addresses can only be between these if they stand for IPv4 ones
        mapped = r"(?i)^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
        group = lambda a, i: F.conv(F.regexp_extract(a, mapped, i), 16, 10).try_cast("long")
        number = lambda a: F.coalesce(ipv4_number(F.regexp_replace(a, r"(?i)^::ffff:(?=\d+\.)", "")), F.when(a.rlike(mapped), group(a, 1) * 65536 + group(a, 2)))
        return Where(lambda c: number(c(column)).between(number(F.lit(low)), number(F.lit(high))), boost)
    return Where(lambda c: ip_key(c(column)).between(ip_key(F.lit(low)), ip_key(F.lit(high))), boost)


def ip_points(column: str, addresses: Sequence[str], boost: float = 1.0) -> Query:
    return Where(lambda c: ip_key(c(column)).isin(*[ip_key(F.lit(a)) for a in addresses]), boost)


def binary_points(column: str, values: Sequence[bytes], boost: float = 1.0) -> Query:
    return Where(lambda c: c(column).isin(*[F.lit(bytearray(v)) for v in values]), boost)


def geo_box(lat: str, lon: str, south: float, north: float, west: float, east: float, boost: float = 1.0) -> Query:
    """Ends included; a box doesn't wrap at the antimeridian."""
    return Where(lambda c: c(lat).between(south, north) & c(lon).between(west, east), boost)


EARTH_RADIUS_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: float, lon2: float) -> Column:
    """Metres between two points on the sphere."""
    a = F.pow(F.sin(F.radians(F.lit(lat2) - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(F.lit(lat2))) * F.pow(F.sin(F.radians(F.lit(lon2) - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def geo_distance(lat: str, lon: str, at_lat: float, at_lon: float, metres: float, boost: float = 1.0) -> Query:
    return Where(lambda c: haversine(c(lat), c(lon), at_lat, at_lon) <= metres, boost)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without direction."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


@dataclass(frozen=True)
class Vector(Query):
    """Every document with a vector (that passes the filter), scored by exact cosine; ``top`` limits to k."""

    column: str
    vector: tuple[float, ...]
    filter: Query | None = None
    boost: float = 1.0
    anywhere = True

    def match(self, p):
        has = p.stored(self.column).isNotNull()
        return has & self.filter.match(p) if self.filter else has

    def score(self, p):
        return cosine(p.stored(self.column), F.array(*[F.lit(float(x)) for x in self.vector])) * float(self.boost)


# compounds


@dataclass(frozen=True)
class Bool(Query):
    """Score: the sum of the matching must and should clauses. Only must_not clauses: no hits."""

    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    minimum: int = 0
    boost: float = 1.0

    @property
    def anywhere(self):  # type: ignore[override]
        if self.must:
            return all(q.anywhere for q in self.must)
        return any(q.anywhere for q in self.should)

    def rewrite(self, index):
        new = [tuple(q.rewrite(index) for q in part) for part in (self.must, self.should, self.must_not)]
        same = all(a is b for old, part in zip((self.must, self.should, self.must_not), new) for a, b in zip(old, part))
        return self if same else replace(self, must=new[0], should=new[1], must_not=new[2])

    def match(self, p):
        object.__setattr__(self, "_shoulds", [])
        if not self.must and not self.should:
            return F.lit(False)
        musts, shoulds = [q.match(p) for q in self.must], [q.match(p) for q in self.should]
        nots = [q.match(p) for q in self.must_not]
        object.__setattr__(self, "_shoulds", shoulds)
        least = max(self.minimum, 0 if self.must else 1)
        out = reduce(lambda x, y: x & y, musts, F.lit(True))
        if least == 1:
            out = out & reduce(lambda x, y: x | y, shoulds, F.lit(False))
        elif least > 1:
            out = out & (sum((s.cast("int") for s in shoulds), F.lit(0)) >= least)
        return reduce(lambda x, y: x & ~y, nots, out)

    def score(self, p):
        total = sum((q.score(p) for q in self.must), F.lit(0.0))
        for q, hit in zip(self.should, self._shoulds):
            total = total + F.when(hit, q.score(p)).otherwise(0.0)
        return total * float(self.boost)


@dataclass(frozen=True)
class DisMax(Query):
    """The best clause, plus tie times the rest."""

    queries: tuple[Query, ...]
    tie: float = 0.0
    boost: float = 1.0

    @property
    def anywhere(self):  # type: ignore[override]
        return any(q.anywhere for q in self.queries)

    def rewrite(self, index):
        new = tuple(q.rewrite(index) for q in self.queries)
        return self if all(a is b for a, b in zip(self.queries, new)) else replace(self, queries=new)

    def match(self, p):
        hits = [q.match(p) for q in self.queries]
        object.__setattr__(self, "_hits", hits)
        return reduce(lambda x, y: x | y, hits)

    def score(self, p):
        each = [F.when(h, q.score(p)) for q, h in zip(self.queries, self._hits)]
        best = F.greatest(*each) if len(each) > 1 else each[0]
        total = sum((F.coalesce(s, F.lit(0.0)) for s in each), F.lit(0.0))
        return (best + self.tie * (total - best)) * float(self.boost)


@dataclass(frozen=True)
class _Wrapper(Query):
    inner: Query

    @property
    def anywhere(self):  # type: ignore[override]
        return self.inner.anywhere

    def rewrite(self, index):
        new = self.inner.rewrite(index)
        return self if new is self.inner else replace(self, inner=new)

    def match(self, p):
        return self.inner.match(p)


@dataclass(frozen=True)
class ConstantScore(_Wrapper):
    value: float = 1.0
    boost: float = 1.0

    def score(self, p):
        return F.lit(float(self.value * self.boost))


@dataclass(frozen=True)
class FunctionScore(_Wrapper):
    """The inner score and a stored value, combined: multiply, replace, sum or max. A missing value keeps the score."""

    value: Callable[[Callable[[str], Column]], Column] = None  # type: ignore[assignment]
    mode: str = "multiply"
    boost: float = 1.0

    def score(self, p):
        s, v = self.inner.score(p), self.value(p.stored).cast("double")
        combined = {"multiply": s * v, "replace": v, "sum": s + v, "max": F.greatest(s, v)}[self.mode]
        return F.when(v.isNull(), s).otherwise(combined) * float(self.boost)


@dataclass(frozen=True)
class FunctionQuery(Query):
    """All documents, scored by a stored value; 0 where it is missing."""

    value: Callable[[Callable[[str], Column]], Column]
    boost: float = 1.0
    anywhere = True

    def match(self, p):
        return F.lit(True)

    def score(self, p):
        return F.coalesce(self.value(p.stored).cast("double"), F.lit(0.0)) * float(self.boost)


# positions


def _chain(at: list[Column], test: Callable[[list[Column]], Column], step: Callable[[Column, Column], Column]) -> Column:
    """Whether positions, one of each array, exist such that neighbours pass ``step`` and all pass ``test``."""

    def deeper(chosen: list[Column]) -> Column:
        i = len(chosen)
        if i == len(at):
            return test(chosen)

        def inside(x: Column) -> Column:
            rest = deeper([*chosen, x])
            return step(chosen[-1], x) & rest if chosen else rest

        return F.exists(at[i], inside)

    return deeper([])


@dataclass(frozen=True)
class _Positional(Query):
    field: str
    terms: tuple[str, ...]
    boost: float = field(default=1.0, kw_only=True)

    def _atoms(self, p: Plan) -> list[Column]:
        ks = [p.atom(Atom(self.field, lambda x, t=t: x == t, positions=True)) for t in self.terms]
        object.__setattr__(self, "_ks", ks)
        return [p.positions(k) for k in ks]

    def score(self, p):
        """Each term by the similarity, with the occurrences of the rarest of them (the first among equals)."""
        info = p.index.term_info(self.field, list(dict.fromkeys(self.terms)))
        rarest = min(range(len(self.terms)), key=lambda i: (info.get(self.terms[i], (0, 0))[0], i))
        tf = p.tf(self._ks[rarest])
        total = F.lit(0.0)
        for t in self.terms:
            df, cf = info.get(t, (0, 0))
            total = total + p.similar(self.field, tf, F.lit(df), F.lit(cf))
        return total * float(self.boost)


@dataclass(frozen=True)
class Phrase(_Positional):
    """Terms one after the other (or at given offsets); each step may be off by slop either way."""

    slop: int = 0
    offsets: tuple[int, ...] = ()

    def match(self, p):
        at = self._atoms(p)
        offs = self.offsets or tuple(range(len(self.terms)))
        if self.slop == 0:
            rest = lambda x: reduce(lambda a, b: a & b, [F.array_contains(c, x + (o - offs[0])) for c, o in zip(at[1:], offs[1:])], F.lit(True))
            return F.exists(at[0], rest)

        def deeper(i: int, before: Column) -> Column:
            if i == len(at):
                return F.lit(True)
            return F.exists(at[i], lambda x: (F.abs(x - before - (offs[i] - offs[i - 1])) <= self.slop) & deeper(i + 1, x))

        return F.exists(at[0], lambda x: deeper(1, x))


@dataclass(frozen=True)
class MultiPhrase(Query):
    """Alternatives for each place; places don't go back, and their deviations add up to slop at most. Constant score."""

    field: str
    groups: tuple[tuple[str, ...], ...]
    slop: int = 0
    boost: float = 1.0

    def match(self, p):
        at = [p.positions(p.atom(Atom(self.field, lambda x, g=g: x.isin(*g), positions=True))) for g in self.groups]
        deviation = lambda xs: sum((F.abs(b - a - 1) for a, b in zip(xs, xs[1:])), F.lit(0)) <= self.slop
        return _chain(at, deviation, lambda a, b: b >= a)


@dataclass(frozen=True)
class NearTerms(_Positional):
    """Span-near over terms: neighbours at most slop + 1 apart, and forward if ordered."""

    slop: int = 0
    ordered: bool = True

    def match(self, p):
        near = (lambda a, b: (b > a) & (b - a <= self.slop + 1)) if self.ordered else (lambda a, b: F.abs(b - a) <= self.slop + 1)
        return _chain(self._atoms(p), lambda xs: F.lit(True), near)


class SpanQuery(Query):
    """Matches where it has a span. Constant score."""

    def match(self, p):
        return F.size(self.spans(p)) > 0


def _span(s: Column, e: Column) -> Column:
    return F.struct(s.alias("s"), e.alias("e"))


@dataclass(frozen=True)
class SpanOf(SpanQuery):
    """The spans of a term, or of any query over terms (prefix, wildcard, regexp, range)."""

    query: _Terms
    boost: float = 1.0

    def spans(self, p):
        return self.query.spans(p)


@dataclass(frozen=True)
class SpanNear(SpanQuery):
    """Spans of the clauses without overlap, the gaps between them adding up to max_gaps at most (None: any).

    Unordered: the width of the whole, less what the clauses cover, is at most max_gaps.
    """

    clauses: tuple[Query, ...]
    max_gaps: int | None = 0
    ordered: bool = True
    boost: float = 1.0

    def _extended(self, acc: Column, nxt: Column, most: int) -> Column:
        """Each span so far with each of the next clause that may follow it."""

        def after(a: Column, n: Column) -> Column:
            return F.struct(a.s.alias("s"), n.e.alias("e"), (a.gap + n.s - a.e).alias("gap"), (a.covered + n.e - n.s).alias("covered"))

        def around(a: Column, n: Column) -> Column:
            return F.struct(F.least(a.s, n.s).alias("s"), F.greatest(a.e, n.e).alias("e"), F.lit(0).alias("gap"), (a.covered + n.e - n.s).alias("covered"))

        if self.ordered:
            return F.flatten(F.transform(acc, lambda a: F.transform(F.filter(nxt, lambda n: (n.s >= a.e) & (a.gap + n.s - a.e <= most)), lambda n: after(a, n))))
        return F.flatten(F.transform(acc, lambda a: F.transform(nxt, lambda n: around(a, n))))

    def spans(self, p):
        each = [q.spans(p) for q in self.clauses]
        most = 2**30 if self.max_gaps is None else self.max_gaps
        acc = F.transform(each[0], lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit(0).alias("gap"), (x.e - x.s).alias("covered")))
        for nxt in each[1:]:
            # of equal spans one is enough; this keeps the frontier small
            acc = F.array_distinct(self._extended(acc, nxt, most))
        if not self.ordered:
            acc = F.filter(acc, lambda a: a.e - a.s - a.covered <= most)
        return F.array_distinct(F.transform(acc, lambda a: _span(a.s, a.e)))


@dataclass(frozen=True)
class SpanOr(SpanQuery):
    clauses: tuple[Query, ...]
    boost: float = 1.0

    def spans(self, p):
        return F.array_distinct(F.concat(*[q.spans(p) for q in self.clauses]))


@dataclass(frozen=True)
class SpanNot(SpanQuery):
    """The first query's documents without any span of the second."""

    include: Query
    exclude: Query
    boost: float = 1.0

    def spans(self, p):
        out = self.include.spans(p)
        return F.when(F.size(self.exclude.spans(p)) == 0, out).otherwise(F.filter(out, lambda x: F.lit(False)))


@dataclass(frozen=True)
class SpanFirst(SpanQuery):
    query: Query
    end: int
    boost: float = 1.0

    def spans(self, p):
        return F.filter(self.query.spans(p), lambda x: x.e <= self.end)


@dataclass(frozen=True)
class SpanContaining(SpanQuery):
    """Spans of big that hold a span of little; with ``within``, those of little inside a big one."""

    big: Query
    little: Query
    within: bool = False
    negate: bool = False
    boost: float = 1.0

    def spans(self, p):
        big, little = self.big.spans(p), self.little.spans(p)
        inside = lambda l, b: (l.s >= b.s) & (l.e <= b.e)
        if self.within:
            return F.filter(little, lambda x: F.exists(big, lambda b: inside(x, b)))
        holds = lambda b: F.exists(little, lambda x: inside(x, b))
        return F.filter(big, (lambda b: ~holds(b)) if self.negate else holds)


@dataclass(frozen=True)
class SpanMask(SpanQuery):
    """Spans of one field where another is expected."""

    query: Query
    field: str
    boost: float = 1.0

    def spans(self, p):
        return self.query.spans(p)


@dataclass(frozen=True)
class SpanPhrase(SpanQuery):
    """Clauses side by side."""

    clauses: tuple[Query, ...]
    boost: float = 1.0

    def spans(self, p):
        return SpanNear(self.clauses, 0, True).spans(p)


# queries that give frames


@dataclass(frozen=True)
class Rrf(Query):
    """Reciprocal rank fusion of the first ``depth`` hits of each query."""

    queries: tuple[Query, ...]
    k: int = 60
    depth: int = 100
    boost: float = 1.0

    def frame(self, index: Index, similarity) -> DataFrame:
        parts = []
        for q in self.queries:
            hits = top(search(index, q, similarity), self.depth)  # depth rows at most: one task ranks them
            parts.append(hits.select("doc_id", (1.0 / (self.k + F.expr("row_number() over (order by score desc, doc_id)"))).alias("part")))
        return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg((F.sum("part") * float(self.boost)).alias("score"))


@dataclass(frozen=True)
class BlockJoin(Query):
    """Parents of any matching child; children name their parent in a stored column."""

    child: Query
    parent_column: str = "parent_id"
    boost: float = 1.0

    def frame(self, index: Index, similarity) -> DataFrame:
        children = search(index, self.child, similarity, scores=False)
        parents = index.docs.select("doc_id", F.col(self.parent_column).alias("parent")).join(children, "doc_id", "left_semi")
        return parents.where("parent is not null and parent <> doc_id").select(F.col("parent").alias("doc_id")).distinct().withColumn("score", F.lit(float(self.boost)))


@dataclass(frozen=True)
class MoreLikeThis(Query):
    """Documents like a given one: its most telling terms as a should query, the document itself left out."""

    doc_id: int
    field: str
    max_terms: int = 25
    min_tf: int = 2
    min_df: int = 5
    max_df: int | None = None
    min_length: int = 3
    boost: float = 1.0

    def frame(self, index: Index, similarity) -> DataFrame:
        n = index.field(self.field).n_docs
        if self.field in index.sources:  # one document is analysed again: postings lie by term
            column, analyse = index.sources[self.field]
            tokens = index.docs.where(F.col("doc_id") == self.doc_id).select(F.explode(analyse(F.col(column))).alias("term"))
            own = tokens.groupBy("term").agg(F.count("*").alias("tf"))
        else:
            own = index.postings.where((F.col("field") == self.field) & (F.col("doc_id") == self.doc_id)).select("term", "tf")
        own = own.where((F.col("tf") >= self.min_tf) & (F.length("term") >= self.min_length))
        stats = index.term_stats.where(F.col("field") == self.field)
        known = stats.join(own, "term").where(F.col("df") >= self.min_df)
        if self.max_df is not None:
            known = known.where(F.col("df") <= self.max_df)
        telling = known.withColumn("w", F.col("tf") * F.log(F.lit(float(n)) / (F.col("df") + 1))).orderBy(F.desc("w"), "term").limit(self.max_terms).collect()
        if not telling:
            return search(index, MatchNone("no telling term"), similarity)
        best = max(r.w for r in telling)
        like = Bool(should=tuple(Term(self.field, r.term, boost=r.w / best if best else 1.0) for r in telling), boost=self.boost)
        return search(index, like, similarity).where(F.col("doc_id") != self.doc_id)
