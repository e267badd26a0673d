"""Fuzzy operators against a brute-force sequential scan."""

import random

from pyspark.sql import functions as F

from scrubline import operators  # noqa: F401
from scrubline.functions.similarity import indel_ratio
from scrubline.operators import dedup


def scan(keys, threshold):
    """Sequential reference: row -> canonical row."""
    texts = [" ".join(sorted(k.split())) for k in keys]
    canonical = {}
    for i in range(len(keys)):
        if i in canonical:
            continue
        canonical[i] = i
        for j in range(i + 1, len(keys)):
            if j not in canonical and indel_ratio(texts[i], texts[j]) >= threshold:
                canonical[j] = i
    return canonical


def words(seed, n):
    rng = random.Random(seed)
    base = ["red apple pie", "green pear tart", "blue plum cake", "ab", "abc", "a", "northern star hotel", "star hotel northern", ""]
    out = []
    for _ in range(n):
        text = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice("abcde ") + text[at + rng.randint(0, 1):]
        out.append(text)
    return out


def check(spark, keys, threshold, probes):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, name string")
    kept = {r.id for r in dedup.remove_fuzzy_duplicates(df, "name", threshold, "id", probes=probes).collect()}
    want = {i for i, c in scan(keys, threshold).items() if i == c}
    assert kept == want


def test_remove_matches_sequential_scan(spark):
    check(spark, words(1, 70), 85, 64)
    check(spark, words(2, 50), 70, 64)


def test_few_probes_give_the_same_rows(spark):
    check(spark, words(3, 40), 85, 4)


def test_low_threshold(spark):
    check(spark, words(4, 25), 40, 64)


def test_groups_and_hot_text(spark):
    df = spark.createDataFrame([(i, "same text here") for i in range(50)] + [(99, "other")], "id int, name string")
    found = dedup.find_fuzzy_duplicates(df, "name", 85, "id")
    assert found.count() == 50
    assert found.where("is_canonical").select("id").collect()[0].id == 0


def test_merge_and_replace(spark):
    df = spark.createDataFrame([(1, "Berlin"), (2, "berlin"), (3, "Berlinn"), (4, "Paris"), (5, None)], "id int, city string")
    merged = {r.id: r.city for r in dedup.fuzzy_match_merge(df, "city", 85, "map", "id").collect()}
    assert merged == {1: "Berlin", 2: "Berlin", 3: "Berlin", 4: "Paris", 5: None}
    replaced = {r.id: r.city for r in dedup.fuzzy_find_replace(df, "city", {"berlin": "BER", "paris": "PAR"}, 90).collect()}
    assert replaced == {1: "BER", 2: "BER", 3: "BER", 4: "PAR", 5: None}


def test_similarity_scores(spark):
    df = spark.createDataFrame([("new york mets", "mets york new")], "a string, b string")
    for method, want in (("token_sort", 1.0), ("token_set", 1.0)):
        assert dedup.calculate_similarity(df, "a", "b", method).select(F.round("similarity_score", 6)).first()[0] == want
    df = spark.createDataFrame([("test", "this is a test!")], "a string, b string")
    assert dedup.calculate_similarity(df, "a", "b", "partial").first().similarity_score == 1.0
    assert abs(dedup.calculate_similarity(df, "a", "b").first().similarity_score - 8 / 19) < 1e-9
