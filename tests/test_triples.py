from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from edgelog.operators import triples
from edgelog.operators.triples import ABSTRACT, FACTS, LABEL
from edgelog.schemas import TRIPLES
from edgelog.sources import label_index


def low(row):
    """Nulls first."""
    return [(value is not None, value or "") for value in row]


def model_lookup(facts, requests, limit):
    rows = []
    for subject, lang in set(requests):
        own = [t for t in facts if t[0] == subject]

        def texts(predicate):
            return [t[2] for t in own if t[1] == predicate and t[3] == "literal" and t[4] == lang] or [None]

        pairs = [(t[1], t[2]) for t in own if t[1] in FACTS] or [(None, None)]
        found = [(a, b, *p) for a, b, p in itertools.product(texts(LABEL), texts(ABSTRACT), pairs)]
        rows += [(subject, lang, *f) for f in sorted(found, key=low)[:limit]]
    return sorted(rows, key=low)


def random_facts(rng, subjects=12, rows=500):
    predicates = [LABEL, ABSTRACT, *FACTS, "other"]
    return [
        (
            "hot" if rng.random() < 0.4 else f"s{rng.randrange(subjects)}",
            rng.choice(predicates),
            f"{rng.choice(['Ab', 'aB', 'b%', 'c_d', 'ß', 'Éa'])}{rng.randrange(30)}",
            rng.choice(["literal", "literal", "literal", "uri"]),
            rng.choice(["en", "en-us", "de", None]),
            None,
        )
        for _ in range(rows)
    ]


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_entity_lookup_against_the_full_product(spark, limit):
    facts = random_facts(random.Random(limit))
    requests = [(s, lang) for s in ["hot", "s1", "s2", "s3", "missing"] for lang in ("en", "de")] * 2
    found = triples.entity_lookup(
        spark.createDataFrame(facts, TRIPLES), spark.createDataFrame(requests, "subject string, lang string"), limit
    )
    assert sorted(map(tuple, found.collect()), key=low) == model_lookup(facts, requests, limit)


def model_search(facts, queries):
    rows = []
    for query_id, text, lang, limit in queries:
        labels = [
            t for t in facts
            if t[1] == LABEL and t[3] == "literal" and t[4] == lang and text.lower() in t[2].lower()
        ]
        found = []
        for t in labels:
            abstracts = [a[2] for a in facts if a[0] == t[0] and a[1] == ABSTRACT and a[3] == "literal" and a[4] == lang]
            found += [(t[0], t[2], a) for a in abstracts or [None]]
        rows += [(query_id, *f) for f in sorted(found, key=low)[: min(max(limit, 1), 50)]]
    return sorted(rows, key=low)


def test_label_search_against_a_plain_scan(spark):
    facts = random_facts(random.Random(3), rows=600)
    texts = ["ab", "A", "%", "_", "B%1", "c_d2", "", "éa", "nothing", "ß1"]
    queries = [
        (f"{text}/{lang}/{limit}", text, lang, limit)
        for text in texts for lang in ("en", "de", "xx") for limit in (0, 5, 500)
    ]
    found = triples.label_search(
        spark.createDataFrame(facts, TRIPLES),
        spark.createDataFrame(queries, "query_id string, text string, lang string, limit int"),
    )
    assert sorted(map(tuple, found.collect()), key=low) == model_search(facts, queries)


def test_patterns(spark):
    facts = random_facts(random.Random(5))
    df = spark.createDataFrame(facts, TRIPLES)
    bound = triples.match_pattern(df, subject="hot", predicate=LABEL).collect()
    expected = [f for f in facts if f[0] == "hot" and f[1] == LABEL]
    assert sorted(map(tuple, bound), key=low) == sorted(expected, key=low)
    first = triples.match_pattern(df, limit=5).collect()
    assert list(map(tuple, first)) == sorted(facts, key=low)[:5]


def test_search_plans(spark, tmp_path):
    path = str(tmp_path / "triples")
    from edgelog.sources.triples import read_triples, write_triples

    write_triples(spark.createDataFrame(random_facts(random.Random(1)), TRIPLES), path)
    queries = spark.sql("SELECT * FROM VALUES ('q', 'ab', 'en') AS t(query_id, text, lang)")
    plan = triples.label_search(read_triples(spark, path), queries)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan
    assert f"(predicate#" in plan and "PartitionFilters: [isnotnull(predicate" in plan


SEARCHES = "query_id string, text string, lang string, limit int"


def test_label_index_with_deltas_against_a_plain_scan(spark, tmp_path):
    facts = random_facts(random.Random(4), rows=600)
    long = [("s1", LABEL, f"An Unusually long label {i}", "literal", "en", None) for i in range(3)]
    facts += [*long, long[0], ("s2", LABEL, None, "literal", "en", None), ("hot", LABEL, "ab", "literal", "en", None)]
    root = str(tmp_path / "index")
    label_index.write_label_index(spark.createDataFrame(facts[:250], TRIPLES), root)
    for _ in range(2):  # a repeated delta replaces itself
        label_index.add_to_label_index(spark.createDataFrame(facts[250:400], TRIPLES), root, 1)
    label_index.add_to_label_index(spark.createDataFrame(facts[400:], TRIPLES), root, 2)
    texts = ["ab", "A", "%", "_", "B%1", "c_d2", "", "éa", "nothing", "ß1", "unusuALLY LONG", "usually long label 2", "x" * 200]
    queries = [(f"{t}/{lang}/{n}", t, lang, n) for t in texts for lang in ("en", "de", "xx") for n in (0, 5, 500)]
    asked = spark.createDataFrame([*queries, ("null", None, "en", 5), ("no lang", "a", None, 5)], SEARCHES)
    found = label_index.search_label_index(spark, root, asked)
    assert sorted(map(tuple, found.collect()), key=low) == model_search([f for f in facts if f[2] is not None], queries)


def test_long_queries_are_found_wherever_they_stand(spark):
    """Of fourteen characters and more, beginning at every place of a block, also among characters of several bytes."""
    draw = random.Random(15)
    letters = "abé\U0001F600 \n.*"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 90))) for _ in range(60)] + ["ab" * 40, "b" + "ab" * 40]
    facts = [(f"s{i}", LABEL, t, "literal", "en", None) for i, t in enumerate(texts)]
    asked = {t[a : a + n] for t in texts[40:] for n in (2, 3, 7, 14, 15, 16, 23, 40) for a in range(0, 20, 3)}
    asked |= {q[:-1] + "z" for q in list(asked) if q}
    queries = [(f"q{i}", q, "en", 50) for i, q in enumerate(sorted(asked))]
    found = triples.label_search(spark.createDataFrame(facts, TRIPLES), spark.createDataFrame(queries, SEARCHES))
    expected = model_search(facts, queries)
    assert len(expected) > 500 and sorted(map(tuple, found.collect()), key=low) == expected


def test_label_index_reads_only_the_rarest_grams(spark, tmp_path):
    """One query of three grams: one part of the postings, at most three of the lengths, one bucket of texts."""
    rows = [(f"s{i}", LABEL, f"common {i:05d}", "literal", "en", None) for i in range(3000)]
    rows.append(("rare", LABEL, "common qxqzq", "literal", "en", None))
    root = str(tmp_path / "index")
    label_index.write_label_index(spark.createDataFrame(rows, TRIPLES), root)
    reads = []
    read = label_index._read

    def watched(spark, root, name, *rest):
        df = read(spark, root, name, *rest)
        files = df.select(F.input_file_name().alias("f")).distinct().collect()
        reads.append((name, {f[0].split(f"{name}/")[1].split("/")[0] for f in files}))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [(" in plan or "PartitionFilters: [isnotnull" in plan or " IN (" in plan
        return df

    label_index._read = watched
    try:
        found = label_index.search_label_index(spark, root, spark.createDataFrame([("q", "n qXqz", "en", 5)], SEARCHES))
        assert [tuple(r) for r in found.collect()] == [("q", "rare", "common qxqzq", None)]
    finally:
        label_index._read = read
    assert [name for name, _ in reads] == ["lengths", "postings", "texts"]
    assert len(reads[0][1]) <= 4 and len(reads[1][1]) == 1 and len(reads[2][1]) == 1


def test_a_lookup_in_a_table_by_subjects_does_not_shuffle_the_triples(spark, tmp_path):
    from edgelog.sources.triples import read_triple_table, write_triple_table

    facts = random_facts(random.Random(8))
    name = f"triples_{tmp_path.name}".replace("-", "_")
    write_triple_table(spark.createDataFrame(facts, TRIPLES), name, str(tmp_path / "table"))
    requests = [(s, lang) for s in ["hot", "s1", "s2", "missing"] for lang in ("en", "de")]
    asked = spark.createDataFrame(requests, "subject string, lang string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = triples.entity_lookup(read_triple_table(spark, name, asked), asked)
        assert sorted(map(tuple, found.collect()), key=low) == model_lookup(facts, requests, 50)
        lines = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line]
    assert len(scans) == 3
    for i in scans:  # from a scan upwards the first operator that moves rows or joins them is the semi join
        above, level = [], depth(lines[i])
        for line in reversed(lines[:i]):
            if depth(line) < level:
                above.append(line.lstrip(" :+-"))
                level = depth(line)
        moved = next(line for line in above if line.startswith(("Exchange", "SortMergeJoin", "ShuffledHashJoin")))
        assert "LeftSemi" in moved, above


def test_postings_are_lists_of_whole_slices(spark):
    """A row for a part of the grams in a slice of labels, and in its lists every subject that has the gram."""
    draw = random.Random(21)
    texts = ["".join(draw.choice("abé\U0001F600") for _ in range(draw.randint(0, 40))) for _ in range(300)]
    facts = [(f"s{i:03d}", LABEL, t, "literal", "en", None) for i, t in enumerate(texts)]
    labels = triples.label_texts(spark.createDataFrame(facts, TRIPLES)).coalesce(1)
    postings = triples.label_postings(labels, 4)
    assert postings.count() <= 4
    keys = {r.key: int(r.subject[1:]) for r in labels.select("key", "subject").collect()}
    listed = {}
    for row in triples.gram_lists(postings).collect():
        listed.setdefault(row.gram, set()).update(keys[k] for k in row.subjects)
    asked = sorted({t[a : a + n] for t in texts for n in (0, 1, 2, 3) for a in range(len(t) - n + 1)})
    queries = spark.createDataFrame([(q, q, "en", 5) for q in asked], SEARCHES)
    for row in triples.wanted_grams(triples.search_needles(queries)).collect():
        having = [i for i, t in enumerate(texts) if row.query_id in t]
        assert listed[row.gram] == set(having if len(row.query_id) > 2 else having[:50])
