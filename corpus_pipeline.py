"""A training-data pipeline over ``documents``: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import base, decontaminate, language_id, mixing, ngram_join, token_store

#: Predictions below this share of the posterior are rejected, as are texts without a letter.
LEAST_SCORE = 0.5
MIX_POSITION = "mix_pos"


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _without(docs: DataFrame, dropped: DataFrame, label: str) -> DataFrame:
    """``docs`` but for the rows whose key is in ``dropped``, which is written first so that its size is known."""
    keyed = docs.withColumn("__key", ngram_join.row_key("doc_id", "text"))
    return keyed.join(base.written(dropped.select(F.col("row_key").alias("__key")).distinct(), label), "__key", "left_anti").select(*_own(docs))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those whose language stays unclear.

    Null and empty texts go; null ids, ties and repeated rows are judged row by row, however long a text is. All columns
    stay, whatever their names; an empty table gives an empty one.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column clashes with the prediction's
    text = names[docs.columns.index("text")]
    guessed = language_id.predict(docs.toDF(*names), model, text_col=text)
    kept = guessed.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*names)
    # written here, so that its Arrow batches are small whoever reads the stage
    return base.written(kept, "languages-kept").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id of each class of near duplicates; of rows that repeat it, one.

    Null and empty texts, and those without a word, are near to nothing and stay, all of them. Null ids come after
    others; a class of them alone keeps one row. All columns stay; an empty table gives an empty one.
    """
    found = ngram_join.similar_documents(docs)
    # by key: whether a row is kept, which then stands for the rows of its key that are not
    keys = found.groupBy("row_key").agg(F.max("kept").alias("kept"), F.min("kept").alias("all_kept"))
    decided = base.written(keys.where("NOT all_kept"), "near-decided")
    rest = _without(docs, decided, "near-dropped")
    again = decided.where("kept").select(F.col("row_key").alias("__key"))
    if again.isEmpty():
        return rest
    repeated = docs.withColumn("__key", ngram_join.row_key("doc_id", "text")).join(again, "__key")
    one = repeated.groupBy("__key").agg(F.any_value(F.struct(*_own(docs))).alias("__row"))
    return rest.unionByName(one.select("__row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null and empty texts hold nothing and stay, as do all rows where there are no items. Rows of equal id and text
    share their fate; ids may be null or repeat. All columns stay; an empty table gives an empty one.
    """
    keyed = docs.select(ngram_join.row_key("doc_id", "text").alias("row_key"), "text")
    hits = decontaminate.contaminated(keyed, base.table(spark, sf_dir, "benchmark"), id_col="row_key", id_type="binary")
    return _without(docs, hits.select(F.col("doc_id").alias("row_key")), "leaks-dropped")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their position in the mix as a last column ``mix_pos`` beside the columns of ``documents``.

    Where ``documents`` has a column of that name, underscores are added to the new one. Null sources are one source,
    null ids and repeated rows have positions of their own; texts are not read. An empty table gives an empty one.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column clashes with the schedule's
    at = dict(zip(docs.columns, names, strict=True))
    mixed = mixing.mix(docs.toDF(*names), source_col=at["source"], id_col=at["doc_id"])
    position = MIX_POSITION
    while position in docs.columns:
        position += "_"
    return mixed.select(*names, "mix_pos").toDF(*docs.columns, position)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token store in mixed order (by doc_id where there is none), read it back: a row for each document.

    Null and empty texts have the end id alone. Rows of equal order are written by id, else in no set order; null ids
    are stored as null. Columns but for id, text and position are left out; an empty table gives an empty one.
    """
    path = base.fresh_path(spark, "pipeline-tokens")
    last, kind = docs.dtypes[-1]
    order = last if last.rstrip("_") == MIX_POSITION and kind == "bigint" else "doc_id"
    token_store.write_store(docs, path, token_store.vocabulary(), order_col=order)
    return token_store.token_digests(token_store.read_store(spark, path))


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each hands on is a table in the shared folder."""
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = base.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL cannot express the stages (fitted models, MinHash bands, a schedule, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
