"""A training-data pipeline over ``documents``: five operators of ``sextant.llm``, one after another.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as
the next one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm import decontaminate, language_id, mixing, set_join, token_output
from sextant.llm.common import WORD, bounded, drop, settle, settling, shared_dir, table
from sextant.llm.queries import tokenizer_path


#: The columns that stages know.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apart(stage: Stage) -> Stage:
    """``stage`` on documents whose other columns bear names of no meaning meanwhile, so that none clashes with a name of its own."""

    @wraps(stage)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        held = [c if c in KNOWN else f"other_column_{k}" for k, c in enumerate(names)]
        return stage(spark, docs.toDF(*held), sf_dir).select(*held).toDF(*names)

    return run_apart


@apart
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (no letter in the text) go; the classifier learns from the labels of the table.

    Where no row has a label there is nothing to judge by, and all documents with a letter stay.
    """
    model = language_id.fit(docs, F.lit(True))
    if not model.languages:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    judge = language_id.classifier(spark, model)
    return docs.where(judge(F.col("text"))["lang_pred"] != language_id.UNKNOWN)


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that pairs with a Jaccard similarity of 0.8 or more over 5-word shingles connect, the one with the least doc_id (null last), then text, stays.

    Covering tables over SimHash fingerprints of 5-word shingles connect most of them, an exact join the rest.
    Rows are judged by their own texts: doc_id may be null or repeat; of rows equal in both one stays. Texts stay in the table: hashes
    stand for them, and texts are compared with each other only where rows of a component share the least doc_id.
    """
    with settling() as made:
        gone, repeated = _behind(docs)
    for old in made:
        if old not in (gone, repeated):
            drop(old)
    rest = _meet(docs, gone, "left_anti")
    if repeated.isEmpty():
        return rest
    return _meet(rest, repeated, "left_anti").unionByName(_meet(rest, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def _meet(docs: DataFrame, named: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``named`` (doc_id, text_hash)."""
    named = bounded(named.toDF("_doc", "_hash"))
    return docs.join(named, docs.doc_id.eqNullSafe(named._doc) & (set_join.text_hash() == named._hash), how)


def _behind(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash): of rows that go, as another of their component comes first; of several equal rows of which one stays."""
    found = set_join.components_of(docs.select("doc_id", "text"), size=5, least=0.8, radius=4)
    nulls_last = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    groups = found.groupBy("component").agg(F.count("*").alias("_rows"), F.min(nulls_last).alias("least")).where("_rows > 1")
    groups = settle(groups.select("component", F.col("least.id").alias("_least")), "groups")
    member = found.join(bounded(groups), "component").groupBy("component", "_least", "doc_id", "text_hash").agg(F.count("*").alias("many"))
    member = settle(member, "members")
    first = member.where(F.col("doc_id").eqNullSafe(F.col("_least")))
    leads = settle(first.groupBy("component").agg(F.min("text_hash").alias("_lead"), F.max("text_hash").alias("_other")), "leads")
    ties = settle(first.join(bounded(leads.where("_lead <> _other")), "component", "left_semi").select("component", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")), "ties")
    few = bounded(ties)
    texts = docs.join(few, docs.doc_id.eqNullSafe(few._doc) & (set_join.text_hash() == few._hash))
    least = texts.groupBy("component").agg(F.min(F.struct("text", "_hash")).alias("_first")).select("component", F.col("_first._hash").alias("_lead"))
    leads = leads.where("_lead = _other").select("component", "_lead").unionByName(least)
    # a text belongs to one component only
    placed = settle(member.join(bounded(settle(leads, "leads")), "component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("_least")) & (F.col("text_hash") == F.col("_lead"))), "placed")
    names = ["doc_id", "text_hash"]
    return settle(placed.where("NOT stays").select(*names), "gone"), settle(placed.where("stays AND many > 1").select(*names), "repeated")


@apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside any occurrence of a benchmark window go."""
    found = decontaminate.contaminated_by(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    hit = bounded(settle(found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "contaminated"))
    return docs.join(hit, docs.doc_id.eqNullSafe(hit._doc) & (F.xxhash64(docs.text) == hit._hash), "left_anti")


@apart
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix of sources takes it, from not at all to three times."""
    names = ["_doc", "_no_doc", "_source", "_no_source", "_size"]

    def keyed(rows: DataFrame, size: Column) -> DataFrame:
        """With the columns ``names``, none of them null, so that one shuffle by them serves all that follows."""
        doc, source = F.col("doc_id"), F.col("source")
        return rows.withColumns(dict(zip(names, (F.coalesce(doc, F.lit(0)), doc.isNull(), F.coalesce(source, F.lit("")), source.isNull(), size), strict=True)))

    # rows of one doc_id, source and size are taken equally often, or some of them once more than the others
    taken = keyed(mixing.mix(docs).select("doc_id", "source", F.col("size").alias("_words"), "copies"), F.col("_words"))
    taken = taken.groupBy(*names).agg(F.min("copies").alias("_least"), F.max("copies").alias("_most"), F.count("*").alias("_rows"), F.sum("copies").alias("_sum"))
    few = F.col("_rows") * F.col("_most") - F.col("_sum")
    own = Window.partitionBy(*names).orderBy("text")
    sized = keyed(docs, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("_own", F.row_number().over(own))
    both = sized.join(taken, names).withColumn("_copies", F.when(F.col("_own") <= few, F.col("_least")).otherwise(F.col("_most")).cast("int"))
    repeated = both.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left; from them: doc_id, start, n_tokens, ids_crc32."""
    path = f"{shared_dir(spark)}/pipeline-tokens-{uuid.uuid4().hex}"
    token_output.write_tokens(docs, path, tokenizer_path(), end_id=1)
    return token_output.read_tokens(spark, path)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spent: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        with settling() as made:
            docs = settle(stage(spark, docs, sf_dir), name, wide=True)
        for old in spent + made[:-1]:  # nothing reads the last stage's frames any more, nor what this one made on its way
            drop(old)
        spent = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL has the language classifier, connected components or the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None
