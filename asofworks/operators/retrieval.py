"""Vector search, rank fusion, quotas and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(vectors: DataFrame, query: list[float], k: int, keep: Column | None = None) -> DataFrame:
    """The ``k`` vectors nearest to one query after the filter; ties by id."""
    rows = vectors if keep is None else vectors.where(keep)
    scored = rows.withColumn("score", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, query))), 6))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


#: What a search may ask of a vector beside nearness, with the vectors' columns; a missing column is null.
FILTERS = {"company": "string", "fiscal_period": "string", "document_type": "string"}


def _with(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    for c, kind in kinds.items():
        df = df.withColumn(c, F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind))
    return df


def _blocks(rows: DataFrame, names: list[str], size: int) -> DataFrame:
    """Neighbouring rows of one key as one row: each column as an array, and the least of ``ts``."""
    kinds = dict(rows.dtypes)

    def run(batches):
        import pyarrow as pa

        held, key, n = [], None, 0

        def out():
            t = pa.concat_tables(held)
            cols = [pa.array([key], pa.string()), pa.array([min(t.column("ts").to_pylist())], pa.int64())]
            for c in names:
                whole = t.column(c).combine_chunks()
                cols.append(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole))
            return pa.RecordBatch.from_arrays(cols, names=["key", "since", *names])

        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and end - at < size:
                    end += 1
                if held and (keys[at] != key or n + end - at > size):
                    yield out()
                    held, n = [], 0
                key = keys[at]
                held.append(pa.Table.from_batches([batch.slice(at, end - at)]))
                n += end - at
                at = end
        if held:
            yield out()

    return rows.mapInArrow(run, "key string, since long, " + ", ".join(f"`{c}` array<{kinds[c]}>" for c in names))


def _nearest():
    """The function of a task: of each pair of a block of vectors and a block of searches, the best of every search that its filters let through."""
    filters = tuple(FILTERS)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(batch.schema.get_field_index(c))[row].values  # noqa: B023, E731
                ids, own = get("vec_id").to_numpy(zero_copy_only=False), get("search_id").to_numpy(zero_copy_only=False)
                x = get("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                q = get("q").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                norm = lambda m: np.sqrt((m * m).sum(1))
                score = np.round((x @ q.T) / norm(x)[:, None] / norm(q)[None, :], 6)
                ok = (get("ts").to_numpy(zero_copy_only=False)[:, None] <= get("until").to_numpy(zero_copy_only=False)[None, :]) & (ids[:, None] != get("skip_id").to_numpy(zero_copy_only=False)[None, :])
                for c in filters:
                    wanted = np.array(get(f"want_{c}").to_pylist(), object)
                    if any(w is not None for w in wanted):
                        ok &= (wanted == None)[None, :] | (np.array(get(c).to_pylist(), object)[:, None] == wanted[None, :])  # noqa: E711
                score[~ok] = -2
                for k in np.unique(top := get("top").to_numpy(zero_copy_only=False)):
                    cols = np.flatnonzero(top == k)
                    part = score[:, cols]
                    least = np.partition(part, max(0, len(ids) - int(k)), axis=0)[max(0, len(ids) - int(k))]
                    u, v = np.nonzero((part >= least) & (part > -2))
                    yield pa.RecordBatch.from_arrays([pa.array(own[cols[v]]), pa.array(ids[u]), pa.array(part[u, v]), pa.array(np.full(len(u), k, np.int32))], names=["search_id", "vec_id", "score", "top"])

    return run


def search(vectors: DataFrame, searches: DataFrame, k: int | None = None, vector_block: int = 1024, search_block: int = 256) -> DataFrame:
    """``(search_id, vec_id, score, rank)``: the nearest vectors of every search by cosine (rounded), each under its own filters; ties by id.

    ``searches(search_id, q)`` and, where wanted, ``k`` (for all, else the argument), ``reference`` (only what was available then; an
    unknown time never is), ``company``, ``fiscal_period``, ``document_type``, ``skip_id``; nulls ask for nothing. ``vectors(vec_id,
    embedding)`` with ``available_ts`` and the filters' columns. Null, zero and non-finite vectors are near to nothing.

    Both sides travel in blocks and meet by an equi-join: searches of a company with the blocks of its vectors alone, which are
    sorted by time so that later blocks are passed over, others with all blocks. Keys are cut to parts of some tens of blocks,
    so neither a large company nor many searches gather in one task, and nothing passes through the driver.
    """
    whole = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    v = _with(vectors, FILTERS | {"available_ts": "timestamp_ntz"}).where(F.col("vec_id").isNotNull() & whole("embedding"))
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.coalesce(micros("available_ts"), F.lit(2**63 - 2)).alias("ts"), *FILTERS)
    s = _with(searches, FILTERS | {"reference": "timestamp_ntz", "skip_id": "long"}).where(whole("q"))
    top = F.lit(k) if k is not None else F.col("k")
    s = s.select(F.col("search_id").cast("long").alias("search_id"), F.col("q").cast("array<double>").alias("q"), top.cast("int").alias("top"), F.coalesce(micros("reference"), F.lit(2**63 - 1)).alias("until"), F.coalesce("skip_id", F.lit(-1)).alias("skip_id"), *[F.col(c).alias(f"want_{c}") for c in FILTERS])
    v_cols, s_cols = ["vec_id", "embedding", "ts", *FILTERS], ["search_id", "q", "top", "until", "skip_id", *[f"want_{c}" for c in FILTERS]]
    per_part = 64 * vector_block
    found = []
    scoped, free = s.where("want_company is not null"), s.where("want_company is null")
    if not scoped.isEmpty():
        sizes = v.join(scoped.select(F.col("want_company").alias("company")).distinct(), "company", "left_semi").groupBy("company").agg(F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
        key = lambda part: F.concat("company", F.lit("#"), part.cast("string")).alias("key")
        own = v.join(sizes, "company").select(key(F.pmod(F.xxhash64("vec_id"), F.col("parts"))), *v_cols)
        asked = scoped.withColumn("company", F.col("want_company")).join(sizes, "company").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(key(F.col("part")), F.col("until").alias("ts"), *s_cols)
        found.append((_blocks(own.repartition("key").sortWithinPartitions("key", "ts"), v_cols, vector_block), _blocks(asked.repartition("key").sortWithinPartitions("key", "until"), s_cols, search_block)))
    if not free.isEmpty():
        n_parts = max(1, -(-v.count() // per_part))
        blocks = _blocks(v.withColumn("key", F.lit("all")), v_cols, vector_block).withColumn("key", F.pmod(F.xxhash64(F.get("vec_id", F.lit(0))), F.lit(n_parts)).cast("string"))  # packed where they lie
        asked = _blocks(free.select(F.lit("all").alias("key"), F.col("until").alias("ts"), *s_cols).repartition("search_id").sortWithinPartitions("until"), s_cols, search_block)
        found.append((blocks, asked.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)).cast("array<string>")))))
    if not found:
        return vectors.sparkSession.createDataFrame([], "search_id long, vec_id long, score double, rank int")
    best = None
    for blocks, asked in found:
        latest = F.array_max("until")
        pairs = blocks.withColumnRenamed("since", "first").join(asked.drop("since"), "key").where(F.col("first") <= latest)
        rows = pairs.select(*v_cols, *s_cols).mapInArrow(_nearest(), "search_id long, vec_id long, score double, top int")
        best = rows if best is None else best.union(rows)
    order = Window.partitionBy("search_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top")).select("search_id", "vec_id", "score", "rank")


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the ``k`` nearest of each of the stated queries ``(query_id, q)``, the vector of the query's own id left out. See :func:`search`."""
    found = search(vectors, queries.select(F.col("query_id").alias("search_id"), "q", F.col("query_id").alias("skip_id")), k)
    return found.select(F.col("search_id").alias("query_id"), "vec_id", "score", "rank")


def rrf(vector: DataFrame, graph: DataFrame, k: int = 60, vector_weight: float = 1.0, graph_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of ``vector(chunk_id, rank)`` and ``graph(evidence_id, chunk_id, rank)``.

    A vector chunk fuses with the best graph row of its chunk and consumes all of them;
    other graph rows stay single.
    """
    best = graph.groupBy("chunk_id").agg(F.min("rank").alias("g"))
    v = vector.withColumnRenamed("rank", "v").join(best, "chunk_id", "left")
    score = F.lit(vector_weight) / (k + F.col("v"))
    fused = v.select(F.concat(F.when(F.col("g").isNull(), "vector:").otherwise("hybrid:"), F.col("chunk_id").cast("string")).alias("evidence_id"), F.when(F.col("g").isNull(), "vector").otherwise("hybrid").alias("source_type"), F.when(F.col("g").isNull(), score).otherwise(score + F.lit(graph_weight) / (k + F.col("g"))).alias("score"))
    rest = graph.join(vector.select("chunk_id"), "chunk_id", "left_anti").select(F.concat(F.lit("graph:"), F.col("evidence_id").cast("string")), F.lit("graph"), F.lit(graph_weight) / (k + F.col("rank")))
    return fused.union(rest)


def ranked(df: DataFrame, *order: Column, by: list[str] | None = None) -> DataFrame:
    """``rank`` from 1 in a total order, over all rows of a result or within groups."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w))


def balanced_top_k(candidates: DataFrame, entities: list, k: int, least: int) -> DataFrame:
    """First ``least`` candidates of each entity (by rank), then the best of the rest, cut at ``k``; ordered by score and rank.

    ``candidates(id, entity, score, rank)`` is one question's ranked pool.
    """
    if len(entities) < 2:
        return candidates.orderBy(F.desc("score"), "rank", "id").limit(k)
    own = Window.partitionBy("entity").orderBy("rank", "id")
    quota = F.col("entity").isin(*entities) & (F.row_number().over(own) <= least)
    marked = candidates.withColumn("reserved", quota)
    # the reserved ones always enter; free places go to the others in order
    free = Window.orderBy(F.desc("reserved"), "rank", "id")
    entered = marked.withColumn("place", F.row_number().over(free)).where((F.col("place") <= k) | F.col("reserved"))
    return entered.orderBy(F.desc("score"), "rank", "id").limit(k).select(candidates.columns)


def rerank(df: DataFrame, overlap: Column, relation: Column, confidence: Column, hops: Column, by: list[str]) -> DataFrame:
    """Linear score of normalised score, token overlap, relation match, confidence and hops (weights .20 .25 .35 .15 -.05)."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    norm = (F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0)
    return df.withColumn("rerank_score", 0.20 * norm + 0.25 * overlap + 0.35 * relation + 0.15 * confidence - 0.05 * F.greatest(F.lit(0), hops - 1))
