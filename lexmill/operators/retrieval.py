"""Sparse and dense retrieval, fusion and reranking over whole query tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import constants as C
from ..functions import text
from ..functions.joins import salted_join
from ..session import parallelism
from ..sources.tables import materialize, plan_bytes

TILE_VECTORS = 20_000
TILE_QUERIES = 1_000
# scores of a tile that are held at a time
BLOCK_CELLS = 1_000_000
# queries that meet a tile at a time; beyond them the tile is copied
GROUP_QUERIES = 50_000
# vectors per ball aimed at, most balls, and the bounded sample their centres and the queries' floors come from
BALL_VECTORS, MAX_BALLS, SAMPLE_VECTORS, CENTRE_ROUNDS = 5_000, 256, 8_192, 5
# postings that a tile of texts holds, and query terms that meet a tile at a time
TILE_POSTINGS, GROUP_TERMS = 2_000_000, 2_000_000
# written size of the asked terms up to which they are broadcast
BROADCAST_TERMS = 4 << 20
# true neighbours an approximate search must meet on its sample, and queries in that sample
LSH_TARGET, LSH_SAMPLE = 0.95, 64


def query_terms(queries: DataFrame, body: str = "text") -> DataFrame:
    """(query_id, term), each term once per query."""
    return queries.select("query_id", F.explode(F.array_distinct(text.word_tokens(F.col(body)))).alias("term"))


def tokenized(corpus: DataFrame, key: str, body: str) -> DataFrame:
    return corpus.select(key, text.word_tokens(F.col(body)).alias("toks")).withColumn("doc_len", F.size("toks"))


def postings(tokens: DataFrame, key: str, terms: DataFrame | None = None) -> DataFrame:
    """(key, doc_len, term, tf), for all terms or only for those asked for.

    The rows of one text come from one task, so the counts combine map-side.
    """
    each = tokens.select(key, "doc_len", F.explode_outer("toks").alias("term"))
    if terms is not None:
        each = each.join(terms.select("term").distinct(), "term", "left_semi")
    return each.groupBy(key, "doc_len", "term").agg(F.count("*").cast("int").alias("tf"))


def sparse_candidates(queries: DataFrame, corpus: DataFrame, key: str, body: str) -> DataFrame:
    """Query terms joined to postings: (query_id, key, term, tf, doc_len)."""
    terms = query_terms(queries)
    found = postings(tokenized(corpus, key, body), key, terms)
    found = found.repartition(parallelism(found.sparkSession), key)
    return salted_join(found, terms, ["term"], key)


def top_k(scored: DataFrame, key: str, k: int) -> DataFrame:
    """Best k per query; the rank filter becomes a group limit before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def counted_per_text(key: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per text from its rows of asked terms, which follow each other and end in the one without ``tid``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # distinct terms, and how often, of a text that the next batch continues
        open_tid, open_tf = np.zeros(0, "int64"), np.zeros(0, "int64")
        for batch in batches:
            is_end = batch["tid"].is_null().to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(is_end)
            at = np.concatenate([np.zeros(len(open_tid), "int64"), np.cumsum(is_end)[~is_end]])
            tid = np.concatenate([open_tid, batch["tid"].drop_null().to_numpy()])
            tf = np.concatenate([open_tf, np.ones(len(batch) - len(ends), "int64")])
            order = np.lexsort((tid, at))
            at, tid, tf = at[order], tid[order], tf[order]
            heads = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(tid, prepend=0) != 0))
            tf = np.add.reduceat(tf, heads) if len(heads) else tf
            at, tid = at[heads], tid[heads]
            done = int(np.searchsorted(at, len(ends)))
            open_tid, open_tf = tid[done:], tf[done:]
            if len(ends):
                starts = pa.array(np.searchsorted(at[:done], np.arange(len(ends) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(x[:done], kind)) for x, kind in ((tid, pa.int64()), (tf, pa.int32()))]
                own = batch.select(["row", key, "doc_len"]).take(pa.array(ends))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*own.columns, *lists], schema, strict=True)], schema=schema)

    return run


def asked_postings(queries: DataFrame, corpus: DataFrame, key: str, body: str) -> tuple[DataFrame, DataFrame]:
    """(terms, postings) of one pass over the texts; terms are known by ``tid``, a 64-bit hash.

    terms: (query_id, tid), each once.  postings: a row per text with its asked terms and how often it holds each;
    ``row`` tells repeated keys apart.  Terms are counted where the text is read, so nothing is shuffled, unless
    the asked terms are too many to be broadcast.
    """
    terms = materialize(query_terms(queries).withColumn("tid", F.xxhash64("term")), "terms")
    toks = tokenized(corpus, key, body).withColumn("row", F.monotonically_increasing_id())
    # the NULL at the end of every text stands for the text itself
    with_end = F.array_append(F.coalesce("toks", F.array().cast("array<string>")), F.lit(None).cast("string"))
    each = toks.select("row", key, "doc_len", F.explode(with_end).alias("term"))
    wanted, near = terms.select("term", "tid").distinct(), plan_bytes(terms) <= BROADCAST_TERMS
    asked = each.join(F.broadcast(wanted) if near else wanted, "term", "left").where("term is null or tid is not null")
    is_text = F.col("tid").isNull()
    asked = asked.select("row", F.when(is_text, F.col(key)).alias(key), F.when(is_text, F.col("doc_len")).alias("doc_len"), "tid")
    if not near:
        asked = asked.repartition(parallelism(asked.sparkSession), "row").sortWithinPartitions("row", F.asc_nulls_last("tid"))
    schema = T.StructType([*asked.schema.fields[:3], T.StructField("tids", T.ArrayType(T.LongType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    for field in schema:
        field.nullable = True
    counted = asked.mapInArrow(counted_per_text(key, to_arrow_schema(schema)), schema)
    # numbers are given by the task, so they are written before they are used
    return terms.select("query_id", "tid"), materialize(counted, "postings")


def weighted(terms: DataFrame, postings: DataFrame) -> tuple[DataFrame, float]:
    """(asked, mean): the idf of every term of a query; the mean length of the texts."""
    size = postings.agg(F.count("*").alias("texts"), F.avg(F.when(F.col("doc_len") >= 0, F.col("doc_len"))).alias("mean")).first()
    texts, mean = size["texts"], size["mean"] or 1.0
    known = postings.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count("*").alias("df"))
    idf = F.log(1 + (texts - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return materialize(terms.join(known, "tid").select("query_id", "tid", idf.alias("idf")), "asked"), mean


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def best_of_tile(key: str, k: int, mean: float, k1: float, b: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores the texts of a tile for the queries that meet it, a query at a time, and keeps its best ``k``."""

    def run(tile: pa.Table, asked: pa.Table) -> pa.Table:
        if not tile.num_rows or not asked.num_rows:
            return schema.empty_table()
        # in order of ties
        in_order = pc.sort_indices(tile.select(["row", key]), sort_keys=[(key, "ascending"), ("row", "ascending")], null_placement="at_start")
        texts = tile.select(["row", key]).take(in_order)
        rows = np.arange(tile.num_rows)
        place = np.empty_like(rows)
        place[in_order.to_numpy()] = rows
        held = pc.list_value_length(tile["tids"]).to_numpy()
        at, length = np.repeat(place, held), np.repeat(tile["doc_len"].fill_null(0).to_numpy(), held)
        tid, tf = (pc.list_flatten(tile[c]).to_numpy() for c in ("tids", "tfs"))
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        order = np.lexsort((at, tid))
        tid, at, part = tid[order], at[order], part[order]
        asked = asked.sort_by([("a_query_id", "ascending"), ("a_tid", "ascending")])
        query, term, idf = asked["a_query_id"].to_numpy(), asked["a_tid"].to_numpy(), asked["idf"].to_numpy()
        low, high = np.searchsorted(tid, term, "left"), np.searchsorted(tid, term, "right")
        heads = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
        out: list[tuple[np.ndarray, ...]] = [(query[:0], np.zeros(0, "int64"), np.zeros(0))]
        for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(query)], strict=True):
            flat = _ranges(low[s:e], high[s:e])
            if not len(flat):
                continue
            score = np.bincount(at[flat], part[flat] * np.repeat(idf[s:e], high[s:e] - low[s:e]), len(rows))
            score = np.floor(score * 1e4 + 0.5) / 1e4
            hit = np.flatnonzero(score > 0)
            if len(hit) > k:
                # all that tie with the k-th best, of which the first in order stay
                hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k]]
            hit = hit[np.argsort(-score[hit], kind="stable")[:k]]
            out.append((np.full(len(hit), query[s]), hit, score[hit]))
        queries, picked, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        best = texts.take(pa.array(picked))
        return pa.table({"query_id": queries, "row": best["row"], key: best[key], "score": scores}).cast(schema)

    return run


def bm25_topk(queries: DataFrame, corpus: DataFrame, key: str, body: str, k: int | str,
              k1: float = C.BM25_K1, b: float = C.BM25_B, budget: int = TILE_POSTINGS, group_terms: int = GROUP_TERMS) -> DataFrame:
    """Exact BM25 top-k per query, for any number of queries and in one pass over the texts.

    ``k`` is a number or the name of a column of ``queries`` that holds each query's own.

    Postings of asked terms are dealt once into tiles of whole texts, about ``budget`` of them in each.  Every
    query meets every tile and leaves its best k of it; so no row per query and text is ever shuffled or written, and what
    travels is the postings, and per tile the queries' terms.  Beyond ``group_terms`` of those, queries are
    grouped and a tile is repeated per group.
    """
    own = None
    if isinstance(k, str):
        own, k = queries.select("query_id", F.col(k).alias("limit")), queries.agg(F.max(k)).first()[0] or 0
    terms, postings = asked_postings(queries, corpus, key, body)
    asked, mean = weighted(terms, postings)
    sizes = postings.agg(F.coalesce(F.sum(F.size("tids") + 1), F.lit(0)).alias("rows"), F.count("*").alias("texts")).first()
    tiles = max(parallelism(postings.sparkSession), min(sizes["texts"], -(-sizes["rows"] // max(budget, 1))))
    groups = max(1, -(-asked.count() // group_terms))
    left = postings.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.select(
        F.col("query_id").alias("a_query_id"), F.col("tid").alias("a_tid"), "idf",
        F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("a_tile"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("a_group"))
    schema = T.StructType([asked.schema["query_id"], T.StructField("row", T.LongType()), left.schema[key], T.StructField("score", T.DoubleType())])
    best = left.groupBy("tile", "group").cogroup(right.groupBy("a_tile", "a_group")).applyInArrow(
        best_of_tile(key, k, mean, k1, b, to_arrow_schema(schema)), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key), F.asc("row"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if own is not None:
        ranked = ranked.join(own, "query_id").where("rank <= limit")
    # written, so that its true size decides whether the join with the texts has to move them
    return materialize(ranked.select("query_id", "rank", key, "score"), "top")


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.asarray(rows.tolist(), dtype="float64")
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def ball_centres(sample: np.ndarray, balls: int) -> np.ndarray:
    """Unit centres of a bounded sample of unit vectors: a few rounds of spherical k-means from its first rows."""
    centres = sample[:balls]
    for _ in range(CENTRE_ROUNDS):
        mine = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms == 0, 1.0, norms), centres)
    return centres


def dealt_to_balls(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, vec, the ball of the nearest centre, and the angle to it.  Zero vectors, which have no direction, are ball -1."""
    kind = vectors.schema["vec"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            unit = _unit(part["vec"])
            angle = _angles(unit, centres)
            ball = angle.argmin(axis=1)
            still = np.linalg.norm(unit, axis=1) == 0
            yield part.assign(ball=np.where(still, -1, ball).astype("int32"), angle=np.where(still, 0.0, angle[np.arange(len(ball)), ball]))

    return vectors.select("id", "vec").mapInPandas(run, f"id BIGINT, vec {kind}, ball INT, angle DOUBLE")


def ball_visits(queries: DataFrame, centres: np.ndarray, balls: dict[int, tuple[float, int]], floor: Callable) -> DataFrame:
    """A row per query and tile of a ball that may hold a vector at or above the query's floor.

    On the unit sphere no vector of a ball is nearer to a query than the angle to the centre less the radius.
    """
    names = np.array(sorted(balls), dtype="int32")
    radius = np.array([balls[b][0] for b in names.tolist()])
    parts = np.array([balls[b][1] for b in names.tolist()])
    kind = queries.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            unit = _unit(part["vec"])
            nearest = np.cos(np.maximum(0.0, _angles(unit, centres)[:, np.maximum(names, 0)] - radius))
            # the zero vector has cosine 0 to everything, and so has a zero query
            nearest[:, names < 0] = 0.0
            nearest[np.linalg.norm(unit, axis=1) == 0] = 0.0
            # scores are rounded to six digits before they are compared
            q, at = np.nonzero(nearest >= floor(unit)[:, None] - 2e-6)
            times = parts[at]
            tile = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            rows = part.iloc[np.repeat(q, times)]
            yield rows.assign(ball=np.repeat(names[at], times), tile=tile.astype("int32"))

    return queries.select("query_id", "vec").mapInPandas(run, f"query_id BIGINT, vec {kind}, ball INT, tile INT")


def dense_plan(queries: DataFrame, vectors: DataFrame, k: int | None, cut: float | None) -> tuple[DataFrame, DataFrame]:
    """(tiles, visits): the vectors in bounded tiles of balls, and which query has to see which tile.

    A query's floor is ``cut``, or the score that its ``k``-th best reaches in a bounded sample.  Up to BALL_VECTORS
    vectors are one ball, in which nothing can be left out.
    """
    vectors, queries = vectors.where("vec IS NOT NULL"), queries.where("vec IS NOT NULL")
    n = vectors.count()
    count = min(MAX_BALLS, -(-n // BALL_VECTORS))
    width = vectors.sparkSession.sparkContext.defaultParallelism
    if count <= 1:
        tiles = max(width, -(-n // TILE_VECTORS))
        one = vectors.select("id", "vec", F.lit(0).alias("ball"), F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile"))
        every = queries.select("query_id", "vec", F.lit(0).alias("ball"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
        return one, every
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_VECTORS).select("vec").toPandas()["vec"]
    sample = _unit(drawn)
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    centres = ball_centres(sample, count) if len(sample) else np.zeros((1, len(drawn.iloc[0])))
    dealt = materialize(dealt_to_balls(vectors, centres), "balls")
    sizes = dealt.groupBy("ball").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # one row per ball
    balls = {r["ball"]: (r["radius"] + 1e-9, -(-r["n"] // TILE_VECTORS)) for r in sizes}
    parts = F.coalesce(*[F.when(F.col("ball") == b, t) for b, (_, t) in balls.items() if t > 1], F.lit(1))
    tiles = dealt.select("id", "vec", "ball", F.pmod(F.xxhash64("id"), parts).cast("int").alias("tile"))

    def floor(unit: np.ndarray) -> np.ndarray:
        if cut is not None or len(sample) < k:
            return np.full(len(unit), -2.0 if cut is None else cut)
        return np.partition(np.round(unit @ sample.T, 6), len(sample) - k, axis=1)[:, len(sample) - k]

    return tiles, ball_visits(queries, centres, balls, floor)


def _scored_tiles(tiles: DataFrame, visits: DataFrame, n_queries: int, keep: Callable) -> DataFrame:
    """Cosine of each tile's vectors and the queries that visit it, ``keep`` applied to blocks of at most TILE_QUERIES and BLOCK_CELLS.

    Vectors travel once for every GROUP_QUERIES queries; a group holds a tile and at most about that many.
    """
    groups = max(1, -(-n_queries // GROUP_QUERIES))
    left = tiles.withColumn("qt", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else tiles.withColumn("qt", F.lit(0))
    right = visits.withColumn("qt", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    right = right.withColumnsRenamed({"ball": "q_ball", "tile": "q_tile", "qt": "q_qt"})

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        held = [pd.DataFrame({"query_id": np.zeros(0, "int64"), "id": np.zeros(0, "int64"), "score": np.zeros(0)})]
        if len(a) and len(b):
            unit, ids = _unit(a["vec"]), a["id"].to_numpy()
            # a task holds a few arrays of BLOCK_CELLS numbers, however full the tile is
            step = max(1, min(TILE_QUERIES, BLOCK_CELLS // len(a)))
            for at in range(0, len(b), step):
                part = b.iloc[at : at + step]
                cos = np.round(_unit(part["vec"]) @ unit.T, 6)
                q, v = keep(cos, ids)
                held.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[q], "id": ids[v], "score": cos[q, v]}))
        return pd.concat(held)

    return (
        left.groupBy("ball", "tile", "qt").cogroup(right.groupBy("q_ball", "q_tile", "q_qt"))
        .applyInPandas(score, "query_id BIGINT, id BIGINT, score DOUBLE")
    )


def dense_candidates(queries: DataFrame, vectors: DataFrame, floor: float) -> DataFrame:
    """Every (query, vector) pair whose cosine reaches the floor; balls that cannot reach it are not visited."""
    tiles, visits = dense_plan(queries, vectors, None, floor)
    return _scored_tiles(tiles, visits, queries.count(), lambda cos, ids: np.nonzero(cos >= floor))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k: top-k inside each visited tile, then across tiles."""

    def best(cos: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((np.broadcast_to(ids, cos.shape), -cos), axis=1)[:, :k]
        return np.repeat(np.arange(cos.shape[0]), order.shape[1]), order.ravel()

    tiles, visits = dense_plan(queries, vectors, k, None)
    scored = _scored_tiles(tiles, visits, queries.count(), best)
    return top_k(scored, "id", k).select("query_id", "rank", "id", "score")


def dense_pairs_scored(tiles: DataFrame, visits: DataFrame) -> DataFrame:
    """How many (query, vector) pairs a plan scores."""
    sizes = tiles.groupBy("ball", "tile").agg(F.count("*").alias("n"))
    return visits.groupBy("ball", "tile").agg(F.count("*").alias("q")).join(sizes, ["ball", "tile"]).agg(F.sum(F.col("q") * F.col("n")).alias("pairs"))


def sign_planes(count: int, dim: int) -> np.ndarray:
    """Directions of +1 and -1 from the first hex digit of an MD5, so that any engine can make them."""
    digit = [[int(hashlib.md5(f"{p}:{i}".encode()).hexdigest()[0], 16) for i in range(dim)] for p in range(count)]
    return np.where(np.array(digit).reshape(count, dim) < 8, 1.0, -1.0)


def band_bits(rows: int) -> int:
    """Bits per band; one more for every doubling, so that a bucket holds about as many vectors at any size."""
    return max(4, math.ceil(math.log2(max(2, rows))) - 3)


def signatures(df: DataFrame, key: str, dim: int, bands: int, bits: int) -> DataFrame:
    """(key, vec, buckets, doubt): the bits of each band, and per band one mask per bit, the least certain first.

    Certainty is the distance from the plane, rounded so that any engine orders it alike; ties go by bit.
    """
    planes = sign_planes(bands * bits, dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        power = 1 << np.arange(bits, dtype="int64")
        for part in batches:
            m = np.asarray(part["vec"].tolist(), dtype="float64").reshape(len(part), dim)
            dots = (m @ planes.T).reshape(len(m), bands, bits)
            doubt = power[np.argsort(np.round(np.abs(dots), 9), axis=2, kind="stable")]
            yield part.assign(buckets=list((dots > 0) @ power), doubt=[list(d) for d in doubt])

    kinds = [df.schema[c].dataType.simpleString() for c in (key, "vec")]
    rows = df.where("vec IS NOT NULL").select(key, "vec")
    return rows.mapInPandas(run, f"{key} {kinds[0]}, vec {kinds[1]}, buckets ARRAY<BIGINT>, doubt ARRAY<ARRAY<BIGINT>>")


def flips_needed(query: str, doubt: str, vector: str) -> Column:
    """How many of a query's least certain bits must be flipped in all ways until a vector's bucket is met in some band."""
    def of_band(z: Column) -> Column:
        apart = z[query].bitwiseXOR(z[vector])
        return F.array_max(F.transform(z[doubt], lambda mask, i: F.when(apart.bitwiseAND(mask) != 0, i + 1).otherwise(0)))

    return F.array_min(F.transform(F.arrays_zip(query, doubt, vector), of_band))


def probe_bits(queries: DataFrame, vectors: DataFrame, index: DataFrame, asked: DataFrame, bits: int, k: int,
               target: float, sample: int) -> int:
    """The fewest bits to flip that find ``target`` of the true neighbours of a bounded sample of queries."""
    chosen = queries.orderBy(F.md5(F.col("query_id").cast("string")), "query_id").limit(sample)
    true = dense_topk(chosen, vectors, k).select("query_id", "id")
    both = true.join(asked.select("query_id", F.col("buckets").alias("q"), "doubt"), "query_id").join(
        index.select("id", F.col("buckets").alias("v")), "id")
    need = both.select(flips_needed("q", "doubt", "v").alias("need"))
    # a row per number of bits at most
    counts = {r["need"]: r["n"] for r in need.groupBy("need").agg(F.count("*").alias("n")).collect()}
    found, total = 0, sum(counts.values())
    for m in range(bits + 1):
        found += counts.get(m, 0)
        if found >= target * total:
            return m
    return bits


def _met(buckets: np.ndarray, asked: np.ndarray, masks: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of queries, and whether each vector of a tile is in a bucket that a query of the block visits.

    A query visits its bucket of every band with the bits of its mask in all ways.  It looks these up in the tile's
    buckets, or tests each of the tile's buckets if they are fewer; a block has at most BLOCK_CELLS of either.
    """
    step = max(1, min(TILE_QUERIES, BLOCK_CELLS // len(buckets)))
    bands = [np.unique(b, return_counts=True) for b in buckets.T]
    places = [np.argsort(b, kind="stable") for b in buckets.T]
    for at in range(0, len(asked), step):
        rows = slice(at, at + step)
        met = np.zeros((len(asked[rows]), len(buckets)), dtype=bool)
        for (names, counts), place, q, mask in zip(bands, places, asked[rows].T, masks[rows].T, strict=True):
            flips = int(np.bitwise_count(mask[0]))
            if 1 << flips <= len(names):
                visits = q[:, None]
                rest = mask.copy()
                for _ in range(flips):
                    lowest = rest & -rest
                    visits, rest = np.concatenate([visits, visits ^ lowest[:, None]], axis=1), rest ^ lowest
                spot = np.minimum(np.searchsorted(names, visits), len(names) - 1)
                i, n = np.nonzero(names[spot] == visits)
                spot = spot[i, n]
            else:
                i, spot = np.nonzero(((names ^ q[:, None]) & ~mask[:, None]) == 0)
            ends = np.cumsum(counts)[spot]
            met[np.repeat(i, counts[spot]), place[_ranges(ends - counts[spot], ends)]] = True
        yield rows, met


def dense_topk_lsh(queries: DataFrame, vectors: DataFrame, k: int, dim: int, bands: int = 32,
                   target: float = LSH_TARGET, sample: int = LSH_SAMPLE) -> DataFrame:
    """Approximate top-k by multi-probe sign bands, rescored exactly; ``met`` counts the pairs a query scored.

    A query visits its own bucket of each band and those reached by flipping its least certain bits; how
    many bits is fitted on ``sample`` queries so that ``target`` of their true neighbours are met.  The index is a row
    per vector, dealt into tiles.  Buckets are looked up inside a tile, which gives its best k of a query, so
    there is no row per band, per visited bucket or per pair, and none of them is broadcast.
    """
    n = vectors.count()
    bits = band_bits(n)
    index = materialize(signatures(vectors, "id", dim, bands, bits).drop("doubt"), "index")
    asked = materialize(signatures(queries, "query_id", dim, bands, bits), "asked")
    m = probe_bits(queries, vectors, index, asked, bits, k, target, sample)
    tiles = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // TILE_VECTORS))
    groups = max(1, -(-asked.count() // GROUP_QUERIES))
    flipped = F.transform("doubt", lambda d: F.reduce(F.slice(d, 1, m), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y)))
    left = index.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.select(
        "query_id", "vec", "buckets", flipped.alias("masks"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"),
        F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        held = [pd.DataFrame({"query_id": np.zeros(0, "int64"), "id": np.zeros(0, "int64"), "score": np.zeros(0), "met": np.zeros(0, "int64")})]
        if len(a) and len(b):
            unit, ids, wanted = _unit(a["vec"]), a["id"].to_numpy(), _unit(b["vec"])
            names = b["query_id"].to_numpy()
            buckets, visited, masks = (np.asarray(x.tolist(), dtype="int64") for x in (a["buckets"], b["buckets"], b["masks"]))
            for rows, met in _met(buckets, visited, masks):
                for name, vec, row in zip(names[rows], wanted[rows], met, strict=True):
                    at = np.flatnonzero(row)
                    score = np.round(unit[at] @ vec, 6)
                    top = np.lexsort((ids[at], -score))[:k]
                    # the first row of a query carries how many it met in the tile
                    count = np.where(np.arange(len(top)) == 0, len(at), 0)
                    held.append(pd.DataFrame({"query_id": name, "id": ids[at[top]], "score": score[top], "met": count}))
        return pd.concat(held)

    scored = left.groupBy("tile", "group").cogroup(right.groupBy("tile", "group")).applyInPandas(
        best, "query_id BIGINT, id BIGINT, score DOUBLE, met BIGINT")
    scored = materialize(scored, "scored")
    sizes = scored.groupBy("query_id").agg(F.sum("met").alias("met"))
    return top_k(scored.drop("met"), "id", k).join(sizes, "query_id").select("query_id", "rank", "id", "score", "met")


def rrf(lists: list[DataFrame], key: str, limit: int, k: int = C.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists of (query_id, key, rank)."""
    both = lists[0].select("query_id", key, "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select("query_id", key, "rank"))
    fused = both.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"))
    return top_k(fused, key, limit).select("query_id", "rank", key, "score")


def coverage_score(wanted: Column, held: Column) -> Column:
    """Stand-in cross scorer: share of the query's tokens found, on a -6..6 scale."""
    terms = F.array_distinct(wanted)
    share = F.size(F.array_intersect(terms, held)) / F.size(terms)
    return F.when((F.size(terms) > 0) & (F.size(held) > 0), F.round(12.0 * share - 6.0, 4))


#: Scorers by name: functions of two token columns; a model would be a pandas UDF here.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"coverage": coverage_score}


def rerank(candidates: DataFrame, key: str, query_tokens: str, tokens: str, limit: int, scorer: str = "coverage") -> DataFrame:
    """Rescore fused candidates and keep the best.

    If any candidate of a query gets no score, the whole query keeps its fused
    order and all of its rerank scores become NULL.
    """
    scored = candidates.withColumn("raw", SCORERS[scorer](F.col(query_tokens), F.col(tokens)))
    group = Window.partitionBy("query_id")
    whole = F.min(F.col("raw").isNotNull().cast("int")).over(group) == 1
    scored = scored.withColumn("rerank_score", F.when(whole, F.col("raw")))
    order = group.orderBy(F.desc_nulls_last("rerank_score"), F.asc("rank"), F.asc(key))
    return (
        scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= limit)
        .select("query_id", F.col("new_rank").alias("rank"), key, "score", "rerank_score")
    )
