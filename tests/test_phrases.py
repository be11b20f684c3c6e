"""One automaton against one pattern for each phrase."""

import random

import regex
from pyspark.sql import functions as F

from tidemark.functions.text import phrases_in
from tidemark.operators import phrases as P

ROWS = "k long, text string, phrase string"


def pattern(phrase):
    words = [r"\s*'?\s*".join(regex.escape(c) for c in w.replace("'", "")) for w in phrase.split()]
    return regex.compile(r"(?i)\b" + r"\W+".join(words) + r"\b")


def test_same_as_patterns(spark):
    texts = ["Let's go", "lets go", "le ts-go", "outlets go", "let''s go", "LET ' S, GO!", "no way", "I know ways", "no   way.", "no-way no_way", "naïve ÉTÉ été", "état", "a1 b2", "go", "", None, "o'f the", "of\nthe", "ofthe", "t o", "x  y'z", "ALL all alll"]
    phrases = ("lets go", "let's go", "no way", "été", "a1 b2", "go", "of the", "to", "x yz", "xyz", "xy z", "all", "naïve")
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], ROWS)
    got = {(r.k, r.phrase) for r in P.phrase_hits(df, ["k"], "text", spark.createDataFrame([(p,) for p in phrases] * 2, "phrase string")).collect()}
    want = {(r.k, p) for r in df.select("k", phrases_in(F.col("text"), phrases).alias("p")).collect() for p in r.p or []}
    assert got == want and got == {(k, p) for k, t in enumerate(texts) if t for p in phrases if pattern(p).search(t)}


def test_ten_thousand_phrases_in_several_automata(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 4))) for _ in range(60)]
    phrases = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4))) for _ in range(30_000)})[:10_000]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "  ", ", ", "'", " '", "-"]) for _ in range(40)) for _ in range(12)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], ROWS)
    listed = spark.createDataFrame([(p,) for p in [*phrases, "!!", "", None]], "phrase string")
    compiled = [(p, pattern(p)) for p in phrases]
    want = {(k, p) for k, t in enumerate(texts) for p, x in compiled if x.search(t)}
    got = P.phrase_hits(df, ["k"], "text", listed, most=3_000).collect()
    assert len(got) == len(want) > 100 and {(r.k, r.phrase) for r in got} == want
    assert P.phrase_hits(df, ["k"], "text", listed.limit(0)).count() == 0
