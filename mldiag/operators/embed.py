"""Text and feature embeddings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from mldiag.functions.columns import ref
from mldiag.operators.roles import infer_columns
from mldiag.operators.transforms import feature_embedding, vector_columns
from mldiag.session import cut_lineage, shared_folder, small_batches

# Fixed value: a token is two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
#: Terms that a model may take along; more stay distributed.
DRIVER_TERMS = 200_000
#: Texts and words of a block at most.
BLOCK_TEXTS, BLOCK_WORDS = 4096, 2_000_000


def english_stop_words() -> list[str]:
    """The English list that ships with Spark ML; pass another list where results must match it."""
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower-case tokens of the whole text; a missing text reads as the word nan."""
    words = F.regexp_extract_all(
        F.lower(F.coalesce(text.cast("string"), F.lit("nan"))), F.lit(TOKEN_PATTERN), F.lit(0)
    )
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def _term_counts(df: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str]) -> DataFrame:
    """(id, term, tf), counted inside each document: nothing is shuffled."""
    dropped = frozenset(stop_words)

    @F.pandas_udf("map<string,bigint>")
    def count(documents: pd.Series) -> pd.Series:
        return pd.Series([{t: n for t, n in Counter(words).items() if t not in dropped} for words in documents], dtype=object)

    return df.select(ref(id_col).alias("id"), F.explode(count(tokens(ref(text_col), ()))).alias("term", "tf"))


def vocabulary(
    df: DataFrame,
    id_col: str,
    text_col: str,
    max_features: int | None = None,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """(term, total, df, idf): all terms, or the `max_features` most frequent ones by corpus count, ties by name.

    Term counts combine map-side, so frequent words do not skew the shuffle.
    """
    stop_words = english_stop_words() if stop_words is None else stop_words
    return _vocabulary(_term_counts(df, id_col, text_col, stop_words), df, max_features)


def _vocabulary(counts: DataFrame, df: DataFrame, max_features: int | None) -> DataFrame:
    n_docs = df.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    terms = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    if max_features is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return terms.withColumn("n", n_docs).select("term", "total", "df", idf.alias("idf"))


def tfidf(
    df: DataFrame,
    id_col: str,
    text_col: str,
    max_features: int | None = None,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """(id, term, weight): smoothed TF-IDF over all terms (or a bounded vocabulary), each document scaled to length 1.

    The join with the vocabulary is left to the optimiser, which broadcasts it only while it is small; the window
    per document holds its distinct terms. Documents without any vocabulary term have no rows.
    """
    stop_words = english_stop_words() if stop_words is None else stop_words
    path = shared_folder(df.sparkSession, "term-counts")  # read twice; texts are tokenised once
    _term_counts(df, id_col, text_col, stop_words).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    vocab = _vocabulary(counts, df, max_features).select("term", "idf")
    weighted = counts.join(vocab, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return weighted.select("id", "term", (F.col("w") / norm).alias("weight"))


def tfidf_vectors(
    df: DataFrame,
    id_col: str,
    text_col: str,
    max_features: int | None = None,
    stop_words: Sequence[str] | None = None,
    name: str = "embedding",
) -> DataFrame:
    """Append the same weights as one sparse ML vector per row; terms are numbered by falling corpus count, ties by name.

    Up to `DRIVER_TERMS` terms, or as many as the caller asks for, travel with the model. A larger vocabulary stays distributed: blocks of rows
    look up their own terms only, and the vectors are written once.
    """
    stop_words = english_stop_words() if stop_words is None else stop_words
    vocab = vocabulary(df, id_col, text_col, max_features, stop_words).select("term", "total", "idf")
    if max_features is None:
        path = shared_folder(df.sparkSession, "vocabulary")  # read more than once; texts are tokenised once for it
        with small_batches(df.sparkSession):
            vocab.write.parquet(path)
        vocab = df.sparkSession.read.parquet(path)
        if vocab.count() > DRIVER_TERMS:
            return _block_vectors(df, text_col, stop_words, vocab, name)
    rows = vocab.collect()
    rows.sort(key=lambda r: (-r["total"], r["term"]))
    terms = [r["term"] for r in rows]
    if not terms:
        raise ValueError("no tokens to build a vocabulary from")
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="_tokens", outputCol="_tf")
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="_tf", outputCol="_w"
    )
    unit = Normalizer(p=2.0, inputCol="_w", outputCol=name)
    rows_ = df.withColumn("_tokens", tokens(ref(text_col), stop_words))
    return unit.transform(weigh.transform(counter.transform(rows_))).drop("_tokens", "_tf", "_w")


def _numbered(vocab: DataFrame) -> DataFrame:
    """(term, i, idf): terms numbered by falling corpus count, ties by name, by one sort over all tasks."""
    ordered = cut_lineage(vocab.orderBy(F.desc("total"), "term"))
    place = F.monotonically_increasing_id()
    placed = ordered.withColumns({"part": F.shiftright(place, 33), "at": place.bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, before = {}, 0
    for part in sorted(sizes):
        first[part], before = before, before + sizes[part]
    start = F.create_map(*[F.lit(x).cast("bigint") for pair in first.items() for x in pair])
    return placed.select("term", (start[F.col("part")] + F.col("at")).cast("int").alias("i"), "idf")


def _block_vectors(df: DataFrame, text_col: str, stop_words: Sequence[str], vocab: DataFrame, name: str) -> DataFrame:
    """Rows are written in blocks with their terms as numbers of the block's own list; each block then meets the vocabulary's numbers and
    weights of that list, so that what is shuffled for the vocabulary is a row for each block and term, not for each text and term."""
    spark, size = df.sparkSession, vocab.count()
    kept = [f for f in df.schema.fields if f.name != name]
    plain = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept)
    stops = list(stop_words)

    def encode_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            words = batch.column(batch.num_columns - 1)
            lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            ends, start = np.cumsum(lengths), 0
            while start < len(lengths):
                most = ends[start] - lengths[start] + BLOCK_WORDS
                stop = min(start + BLOCK_TEXTS, max(start + 1, int(np.searchsorted(ends, most, "right"))))
                part, n = batch.slice(start, stop - start), stop - start
                coded = pc.dictionary_encode(part.column(part.num_columns - 1).flatten())
                known, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(n), lengths[start:stop])
                keys, tf = np.unique(row * max(len(known), 1) + code, return_counts=True)
                row, code = keys // max(len(known), 1), keys % max(len(known), 1)
                if stops and len(known):
                    keep = ~pc.is_in(known, value_set=pa.array(stops, known.type)).to_numpy(zero_copy_only=False)[code]
                    row, code, tf = row[keep], code[keep], tf[keep]
                used, code = np.unique(code, return_inverse=True)
                at = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (code, tf)]
                terms = pa.array([known.take(pa.array(used)).to_pylist()] + [None] * (n - 1), pa.list_(pa.string()))
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                fields = [part.schema.field(i) for i in range(part.num_columns - 1)]
                more = [("_block", pa.array(np.full(n, number))), ("_codes", lists[0]), ("_tf", lists[1]), ("_terms", terms)]
                yield pa.RecordBatch.from_arrays(columns + [c for _, c in more], schema=pa.schema(fields + [pa.field(k, c.type) for k, c in more]))
                number, start = number + 1, stop

    path = shared_folder(spark, "text-blocks")
    rows = df.select(*[ref(f.name) for f in kept], tokens(ref(text_col), ()).alias("_words"))
    with small_batches(spark):
        rows.mapInArrow(encode_terms, plain + ", _block bigint, _codes array<int>, _tf array<int>, _terms array<string>").write.parquet(path)
    blocks = spark.read.parquet(path)
    own = blocks.where(F.col("_terms").isNotNull()).select(F.col("_block").alias("block"), F.posexplode("_terms").alias("code", "term"))
    looked = own.join(_numbered(vocab), "term").select("block", "code", "i", "idf")

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        n = left.num_rows
        place, idf = np.zeros(right.num_rows, np.int32), np.zeros(right.num_rows)
        code = right.column("code").to_numpy()
        place[code], idf[code] = right.column("i").to_numpy(), right.column("idf").to_numpy()
        lengths = pc.list_value_length(left.column("_codes")).to_numpy()
        code, tf = (pc.list_flatten(left.column(c)).to_numpy() for c in ("_codes", "_tf"))
        row = np.repeat(np.arange(n), lengths)
        at, w = place[code], tf * idf[code]
        norm = np.sqrt(np.bincount(row, weights=w * w, minlength=n))
        order = np.lexsort((at, row))
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (at, w / norm[row])]
        vector = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], ["type", "size", "indices", "values"])
        columns = [left.column(f) for f in range(left.num_columns) if left.column_names[f] not in ("_block", "_codes", "_tf")]
        names = [c for c in left.column_names if c not in ("_block", "_codes", "_tf")]
        return pa.table([*columns, vector], names=[*names, name])

    asking = blocks.drop("_terms").groupBy("_block").cogroup(looked.groupBy("block"))
    form = f"{plain}, `{name}` struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
    out = shared_folder(spark, "text-vectors")
    asking.applyInArrow(weigh, form).write.parquet(out)
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)  # only this function reads the blocks
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    # read as what the parts are: the vector type has no Arrow form
    return spark.read.schema(StructType([*kept, StructField(name, VectorUDT())])).parquet(out)


def encode(
    df: DataFrame,
    column: str,
    encoder: Callable[[list], np.ndarray],
    name: str = "embedding",
    batch_size: int = 32,
) -> DataFrame:
    """Append vectors from a user's encoder, called on lists of at most `batch_size` values."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            parts = [
                list(np.asarray(encoder(values.iloc[i : i + batch_size].tolist()), dtype=np.float32))
                for i in range(0, len(values), batch_size)
            ]
            yield pd.Series([v for part in parts for v in part])

    return df.withColumn(name, run(ref(column)))


def embed(
    df: DataFrame,
    method: str = "tfidf",
    id_col: str | None = None,
    text_col: str | None = None,
    encoder: Callable[[list], np.ndarray] | None = None,
    image_col: str | None = None,
    **options,
) -> DataFrame:
    """Append `embedding` by method: tfidf, features, text (user encoder) or image (user encoder).

    TF-IDF falls back to the numeric features when the table has no text column.
    """
    if method == "tfidf":
        column = text_col or infer_columns(df).text
        if column is None:
            return feature_embedding(df)
        if id_col is None:
            raise ValueError("tfidf needs the id column")
        return tfidf_vectors(df, id_col, column, **options)
    if method == "features":
        return feature_embedding(df)
    if method in ("text", "image"):
        column = (text_col or infer_columns(df).text) if method == "text" else image_col
        if column is None or encoder is None:
            raise ValueError(f"{method} embedding needs a column and an encoder")
        return encode(df, column, encoder, **options)
    raise ValueError(f"Unknown method: {method}")


def embedding_transform(
    df: DataFrame, vector: str, n_dims: int, n_components: int = 50
) -> DataFrame:
    """Append the first min(n_components, n_dims) embedding elements as emb_0, emb_1, ..."""
    return vector_columns(df, vector, min(n_components, n_dims))
