import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


@pytest.fixture
def terms(spark, tmp_path):
    """Counts of a query over documents whose titles say nothing of their texts."""

    def run(name, *texts):
        docs = spark.createDataFrame([(i, t, "wiki", "title") for i, t in enumerate(texts)], "doc_id long, text string, source string, title string")
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return {r.term: r.n for r in entry.queries()[name](spark, str(tmp_path)).collect()}

    return run


def test_hyphenated_words_of_texts_are_rejoined(terms):
    assert terms("filter_hyphenated", "an exam- ple of a split", None) == {"an": 1, "example": 1, "of": 1, "a": 1, "split": 1}


def test_accents_of_texts_are_folded(terms):
    assert terms("filter_accent_fold_text", "Café déjà", "cafe") == {"Cafe": 1, "deja": 1, "cafe": 1}


def test_reversed_tokens_keep_what_is_one_character(terms, spark):
    import duckdb

    from corpusloom.functions import analysis as an

    assert terms("filter_reverse_text", "คำค abc", "น้ำ", None) == {"คคำ": 1, "cba": 1, "น": 1, "ำ": 1}  # the tone mark between isn't part of a word
    tokens = ["", "abc", "a\r\nb", "คำค", "ກຳກ", "น้ำใจ", "한글", "\u1112\u1161\u11ab\u1100\u1173\u11af", "e\u0301a", "𝒳y", "ｶﾞｷ", "👩\u200d🔬x"]
    got = spark.createDataFrame([([*tokens, None],)], "t array<string>").select(an.reverse(F.col("t"))).first()[0]
    assert got == [*(duckdb.execute("SELECT reverse(?)", [x]).fetchone()[0] for x in tokens), None]


def test_shingles_and_common_grams_of_texts(terms):
    assert terms("filter_shingle_text", "a B c", "") == Counter(["a", "b", "c", "a b", "b c", "a b c"])
    assert terms("filter_common_grams_text", "a Plain query here", None) == Counter(["a", "plain_query", "plain", "query", "here"])


def test_shingles_of_a_long_text_are_made_in_one_pass(terms):
    words = [f"W{i * i % 997}" for i in range(30_000)]
    low = [w.lower() for w in words]
    expected = Counter(" ".join(low[i : i + n]) for n in (1, 2, 3) for i in range(len(low) - n + 1))
    began = time.monotonic()
    assert terms("filter_shingle_text", " ".join(words), "one", "two words", "Ä ß, Two", None, "") == expected + Counter(["one", "two", "words", "two words", "ä", "ß", "two", "ä ß", "ß two", "ä ß two"])
    assert time.monotonic() - began < 60  # minutes if the text is cut into words again for each word


def test_grams_of_long_texts_are_made_in_one_pass(terms, spark):
    from corpusloom.functions import analysis as an

    texts = ["x" * 70 + "日本語" * 60_000, "".join(f"w{i * i % 997} \n"[: 3 + i % 4] for i in range(60_000)), "a", "ab", "ab ", "abc", " a", "\r\n\u0085\u2028𝒳👩\u200d🔬e\u0301x", "", None]
    grams = lambda t: [t[i : i + n] for i in range(len(t)) for n in (2, 3) if i + n <= len(t)]
    began = time.monotonic()
    assert terms("tok_ngram_text", *texts) == Counter(g for t in texts for g in grams(t or ""))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", an.ngrams(2, 3)(F.col("t")).alias("g")).collect()
    assert all(r.g == grams(r.t or "") for r in got)
    assert time.monotonic() - began < 60  # minutes if each place of a text is counted from its start


@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 2), (2, 2), (3, 5)])
def test_grams_of_pieces_are_those_of_the_text(spark, lo, hi):
    from corpusloom.functions import analysis as an

    texts = ["", "a", "ab", "a b", "abc de", "one two, three\n\nfour", "z" * 100, "a  b   c    d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(an.ngrams(lo, hi)(F.col("t")).alias("whole"), an.gram_pieces(hi)(F.col("t")).alias("p"))
    for r in df.select("whole", F.flatten(F.transform("p", lambda p: an.piece_grams(p["piece"], p["starts"], lo, hi))).alias("pieces")).collect():
        assert r.pieces == r.whole


def test_english_arabic_and_unknown_languages(spark):
    from corpusloom.functions.languages import language_analyser

    df = spark.createDataFrame([("Running searches connected the والكتاب المدرسون",), (None,)], "t string")
    assert df.select(language_analyser("en-GB")(F.col("t"))).first()[0][:3] == ["run", "search", "connect"]
    assert df.select(language_analyser("ar")(F.col("t"))).first()[0][-2:] == ["تاب", "مدرس"]
    with pytest.raises(ValueError):
        language_analyser("sk")
    assert df.select(language_analyser("sk", ["the"])(F.col("t"))).first()[0][:3] == ["running", "searches", "connected"]


def test_marks_synonyms_delimiters_and_protected_words(spark):
    from corpusloom.functions import analysis as an
    from corpusloom.functions import stemming

    one = lambda fn, *tokens: spark.createDataFrame([(list(tokens),)], "t array<string>").select(fn(F.col("t"))).first()[0]
    assert one(an.fold_accents, "Dvořák", "Škoda", "őszi", "Ἀθῆναι", "한국어", "ø", "é") == ["Dvorak", "Skoda", "oszi", "Αθηναι", "한국어", "ø", "e"]
    syn = an.synonyms({"new york city": ["nyc"], "new york": ["ny"], "york": ["eboracum"], "city": ["town"]})
    assert one(syn, "new", "york", "city", "new", "york", "york", "city") == "new york city new york york city nyc ny eboracum town".split()
    assert one(syn) == []
    assert one(an.word_delimiter(catenate_words=True, catenate_numbers=True), "Wi-Fi802-11") == ["Wi", "Fi", "802", "11", "WiFi", "80211"]
    assert one(an.word_delimiter(number_parts=False), "A-12", "12") == ["A", "12"]
    assert one(stemming.word_filter(stemming.porter, frozenset(["running"])), "running", "searches", None) == ["running", "search", None]
    assert one(stemming.word_filter(stemming.metaphone, beside=True), "knight", "42") == ["knight", stemming.metaphone("knight"), "42"]
