"""Lookups over ``triples(subject, predicate, object, object_kind, lang, datatype)``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from edgelog.functions import grams
from edgelog.session import importable, written

# The vocabulary the lookups use.
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
ABSTRACT = "http://dbpedia.org/ontology/abstract"
FACTS = (
    "http://dbpedia.org/ontology/birthDate",
    "http://dbpedia.org/ontology/deathDate",
    "http://dbpedia.org/ontology/birthPlace",
    "http://dbpedia.org/ontology/knownFor",
)
ENTITY_ROWS = 50
SEARCH_ROWS = 10
MAX_SEARCH_ROWS = 50
POSTINGS = "lang string, part int, lists array<struct<gram: bigint, n: int, start: int>>, subjects array<int>"


def _ranked(rows: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """Number each group's first ``limit`` rows from 0; cut on the map side already."""
    window = Window.partitionBy(*by).orderBy(*[F.asc_nulls_first(c) for c in order])
    numbered = rows.withColumn("_n", F.row_number().over(window))
    return numbered.where(F.col("_n") <= limit).withColumn("_n", F.col("_n") - 1)


def _literals(triples: DataFrame, predicate: str, name: str, limit: int) -> DataFrame:
    """The first ``limit`` texts per subject and language, and how many those are."""
    texts = triples.where(
        (F.col("predicate") == predicate) & (F.col("object_kind") == "literal")
    ).select("subject", "lang", F.col("object").alias(name))
    first = _ranked(texts, ["subject", "lang"], [name], limit)
    size = F.count(F.lit(1)).over(Window.partitionBy("subject", "lang"))
    return first.select("subject", "lang", name, F.col("_n").alias(f"_{name}_n"), size.alias(f"_{name}s"))


def entity_lookup(triples: DataFrame, requests: DataFrame, limit: int = ENTITY_ROWS) -> DataFrame:
    """Label, abstract and facts for each distinct ``requests(subject, lang)``.

    Every combination of a label, an abstract (both exactly in ``lang``) and a fact is a row, ordered
    by label, abstract, property and value and cut after ``limit`` rows; a request without any
    of them has one row of nulls. The first ``limit`` combinations only use the first ``limit`` labels,
    abstracts and facts, so each list is cut before it is joined, and the joins keep no combination
    whose place is beyond the limit: an entity never grows past ``limit`` rows per list.
    """
    wanted = requests.select("subject", "lang").distinct()
    labels = _literals(triples, LABEL, "label", limit)
    abstracts = _literals(triples, ABSTRACT, "abstract", limit)
    facts = _ranked(
        triples.where(F.col("predicate").isin(*FACTS)).select(
            "subject", F.col("predicate").alias("property"), F.col("object").alias("value")
        ),
        ["subject"],
        ["property", "value"],
        limit,
    ).select(
        F.col("subject").alias("_of"),
        "property",
        "value",
        F.col("_n").alias("_fact_n"),
        F.count(F.lit(1)).over(Window.partitionBy("subject")).alias("_facts"),
    )

    def size(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(1))

    def place(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    both = wanted.join(labels, ["subject", "lang"], "left").join(abstracts, ["subject", "lang"], "left")
    both = both.withColumn("_pair", place("_label_n") * size("_abstracts") + place("_abstract_n")).where(
        F.col("_pair") < limit
    )
    joined = both.join(facts, F.col("subject") == F.col("_of"), "left")
    return joined.where(F.col("_pair") * size("_facts") + place("_fact_n") < limit).select(
        "subject", "lang", "label", "abstract", "property", "value"
    )


def search_needles(queries: DataFrame, limit: int = SEARCH_ROWS) -> DataFrame:
    """query_id, lang, needle (lower case) and _limit (brought into 1..50) of label searches."""
    wanted = F.col("limit") if "limit" in queries.columns else F.lit(limit)
    return queries.select(
        "query_id",
        "lang",
        F.lower("text").alias("needle"),
        F.greatest(F.lit(1), F.least(wanted, F.lit(MAX_SEARCH_ROWS))).alias("_limit"),
    )


def wanted_grams(needles: DataFrame) -> DataFrame:
    """query_id, lang, turn, gram: the grams of which a label that contains the query has all those of some turn.

    Labels are cut into blocks of eight characters. Where a query of fifteen or more stands in a label, the blocks that lie in it begin
    at one of eight places (turns) of the query and follow each other from there. A query of three or more has its runs of three;
    a shorter one is its own gram.
    """
    importable(needles.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("needle").cast(pa.large_binary()).to_pylist()):
                for turn, found in grams.query_grams(text):
                    at = pa.array([i] * len(found), pa.int32())
                    columns = [batch.column("query_id").take(at), batch.column("lang").take(at)]
                    columns += [pa.array([turn] * len(found), pa.int32()), pa.array(found.view("int64"))]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "lang", "turn", "gram"])

    asked = needles.where(F.col("needle").isNotNull() & F.col("lang").isNotNull()).select("query_id", "lang", "needle")
    schema = StructType(asked.schema.fields[:2]).add("turn", IntegerType()).add("gram", LongType())
    return asked.mapInArrow(cut, schema)


def label_texts(triples: DataFrame) -> DataFrame:
    """subject, lang, label, haystack (lower case) and key (a hash of the subject) of all labels."""
    labels = triples.where((F.col("predicate") == LABEL) & (F.col("object_kind") == "literal"))
    return labels.select("subject", "lang", F.col("object").alias("label"), *searched(F.col("object")))


def searched(label: Column) -> tuple[Column, Column]:
    """What labels are searched by, besides their language."""
    return F.lower(label).alias("haystack"), F.hash("subject").alias("key")


def label_postings(labels: DataFrame, parts: int = 1) -> DataFrame:
    """lang, part, lists (gram, n, start), subjects: in which subjects' labels a gram occurs: blocks of eight characters and shorter runs.

    A row holds the lists of a part of the grams in a slice of labels, one behind the other: a subject is named by a 32-bit hash (its
    ``key``), since each that is found is compared with its texts. Of grams shorter than three characters a task lists its
    first ``MAX_SEARCH_ROWS`` subjects: having such a gram is containing the query, and each subject has a row at least.
    """
    importable(labels.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grams.cut_labels(batches, MAX_SEARCH_ROWS, parts)

    given = labels.where("haystack IS NOT NULL AND lang IS NOT NULL AND subject IS NOT NULL")
    given = given.sortWithinPartitions("lang", "subject").select("lang", "key", "haystack")
    return given.mapInArrow(cut, POSTINGS)


def gram_lists(postings: DataFrame) -> DataFrame:
    """lang, gram, subjects (keys) of ``label_postings``; a gram has a list for each slice that it occurs in."""
    lists = postings.select("lang", "subjects", F.inline("lists"))
    return lists.select("lang", "gram", F.slice("subjects", F.col("start"), F.col("n")).alias("subjects"))


def rarest_grams(wanted: DataFrame, lengths: DataFrame) -> DataFrame:
    """query_id, lang and, for each turn of each query, the gram that fewest labels have, by ``lengths`` (lang, gram, n).

    A gram that no label has ends the turn.
    """
    rated = wanted.join(lengths, ["lang", "gram"], "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")
    rarest = rated.groupBy("query_id", "lang", "turn").agg(rarest)
    return rarest.where("r.n > 0").select("query_id", "lang", F.col("r.gram").alias("gram")).distinct()


def search_candidates(needles: DataFrame, chosen: DataFrame, lists: DataFrame) -> DataFrame:
    """The subjects (keys) that each query is compared with: those that have a gram chosen for it."""
    met = lists.join(chosen, ["lang", "gram"]).select("query_id", "lang", F.explode("subjects").alias("key")).distinct()
    return met.join(needles, ["query_id", "lang"])


def search_rows(candidates: DataFrame, labels: DataFrame, abstracts: DataFrame) -> DataFrame:
    """query_id, entity, label, abstract of the candidates whose label contains the query, as many as it asks for."""
    pairs = labels.where(F.col("subject").isNotNull()).join(candidates, ["key", "lang"])
    hits = pairs.where(F.contains(F.col("haystack"), F.col("needle"))).select(
        "query_id", "lang", "_limit", "subject", "label"
    )
    # The order starts with entity and label, so later rows cannot come back with the abstracts.
    hits = _ranked(hits, ["query_id"], ["subject", "label"], MAX_SEARCH_ROWS)
    hits = hits.where(F.col("_n") < F.col("_limit")).drop("_n")
    found = hits.join(abstracts, ["subject", "lang"], "left")
    found = _ranked(found, ["query_id"], ["subject", "label", "abstract"], MAX_SEARCH_ROWS)
    return found.where(F.col("_n") < F.col("_limit")).select(
        "query_id", F.col("subject").alias("entity"), "label", "abstract"
    )


def first_abstracts(triples: DataFrame) -> DataFrame:
    """subject, lang, abstract: as many as a search can show."""
    return _literals(triples, ABSTRACT, "abstract", MAX_SEARCH_ROWS).select("subject", "lang", "abstract")


def label_search(triples: DataFrame, queries: DataFrame, limit: int = SEARCH_ROWS) -> DataFrame:
    """Entities whose label in the query's language contains the query text, ignoring case.

    ``queries(query_id, text, lang)``, one row per id and language, may have a ``limit`` column; limits are brought
    into 1..50. Rows are ordered by entity, label and abstract. Queries meet labels on their rarest blocks of eight or runs of three
    characters (short ones on the whole query), whatever the sizes, and are then compared with the texts.

    Labels are cut into grams once for all queries, and the postings that these need are written once. For many
    searches over the same triples keep them as a ``sources.label_index``.
    """
    needles = search_needles(queries, limit)
    wanted = wanted_grams(needles)
    # By subject, as the comparison with the texts needs them, and in as many parts as a shuffle has: few bytes make many grams.
    parts = int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = label_texts(triples).repartition(parts, "key", "lang")
    lists = gram_lists(label_postings(labels)).join(wanted.select("lang", "gram").distinct(), ["lang", "gram"], "left_semi")
    lists = written(lists, "label_postings")
    lengths = lists.groupBy("lang", "gram").agg(F.sum(F.size("subjects")).alias("n"))
    candidates = search_candidates(needles, rarest_grams(wanted, lengths), lists)
    return search_rows(candidates, labels, first_abstracts(triples))


def match_pattern(
    triples: DataFrame,
    subject: str | None = None,
    predicate: str | None = None,
    object: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Triples that match the bound positions; with a limit, the first ones in s, p, o order."""
    bound = {"subject": subject, "predicate": predicate, "object": object}
    found = triples
    for column, value in bound.items():
        if value is not None:
            found = found.where(F.col(column) == value)
    if limit is None:
        return found
    order = ["subject", "predicate", "object", "object_kind", "lang", "datatype"]
    return found.orderBy(*[F.asc_nulls_first(c) for c in order]).limit(limit)
