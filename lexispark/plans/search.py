"""The search pipeline over all queries at once: retrieve, unite, fuse, boost, rerank, shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..operators import clinical, fusion, lexical, rerank, trace
from ..operators.scores import top_k


class Search(dict):
    """The frames of a run: ``result`` and ``trace``. Their ranked lists are persisted until ``close`` (or the end of a
    ``with`` block); Spark rebuilds what an executor loses."""

    def __init__(self, result: DataFrame, trace_: DataFrame, held: list[DataFrame]):
        super().__init__(result=result, trace=trace_)
        self.held = held

    def close(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held = []

    def __enter__(self) -> Search:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def search(docs: DataFrame, queries: DataFrame, cfg: SearchConfig = SearchConfig(), dense: DataFrame | None = None, lexicon: DataFrame | None = None) -> Search:
    """Runs the pipeline on docs (doc_id, text) and queries (qid, text).

    ``dense``: ranked (qid, doc_id, score, rank) of a vector search, if any. ``lexicon``: (condition, kind, norm), if any.
    The final ranking is (qid, doc_id, score, rank). A query without hits has no rows; without ``dense`` the lexical hits go on
    alone. Texts are read again only once after retrieval, cut to the candidates, and go with them through rerank and biases.
    """
    # at most top_bm25 rows a query, used by several stages below
    hits = lexical.bm25_top(docs, queries, cfg.top_bm25, cfg.bm25, qid="qid").withColumn("source", F.lit("bm25")).persist()
    held = [hits]
    stages = [trace.stage(hits, "bm25", {"k": str(cfg.top_bm25)})]
    lists = hits
    if dense is not None:
        near = dense.filter(F.col("rank") <= cfg.top_dense).withColumn("source", F.lit("dense"))
        stages.append(trace.stage(near, "dense", {"k": str(cfg.top_dense)}))
        lists = hits.unionByName(near.select(*hits.columns))
    fused = fusion.fuse(lists, cfg.fusion).select("qid", "doc_id", "score")
    conditions = None
    if lexicon is not None:
        conditions = clinical.detect(queries, lexicon).persist()
        held.append(conditions)
        among = None if cfg.force_include else hits
        # without forced documents only hits can be united: the index is made of these
        indexed = docs if among is None else docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
        union = conditions.join(clinical.condition_index(indexed, lexicon), "condition").withColumn("ord", F.col("condition"))
        united = fusion.union_cap(union, ["ord"], cfg.union_cap, among)
        fused = fusion.union_boost(fused, united, cfg.union_boost)
    fused = top_k(fused, ["qid"], cfg.fused_cap).persist()
    held.append(fused)
    stages.append(trace.stage(fused, "fused", {"method": cfg.fusion.method}))
    head = fused.filter(F.col("rank") <= cfg.rerank_top)
    texts = docs.join(head.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("text").alias("_d")).persist()
    held.append(texts)
    pairs = head.join(texts, "doc_id").join(queries.select("qid", F.col("text").alias("_q")), "qid")
    scored = rerank.overlap(pairs, "_q", "_d").drop("_d", "_q")
    if conditions is not None:
        biases = clinical.bias(head, texts.withColumnRenamed("_d", "text"), conditions, lexicon, cfg.bias_positive, cfg.bias_penalty)
        scored = scored.join(biases, ["qid", "doc_id"], "left").withColumn("ce", F.col("ce") + F.coalesce("bias", F.lit(0.0))).drop("bias")
    final = top_k(scored.select("qid", "doc_id", (0.5 * F.col("ce") + 0.5 * F.col("score")).alias("score")), ["qid"], cfg.final_k)
    stages.append(trace.stage(final, "reranked", {"k": str(cfg.final_k)}))
    return Search(final, trace.combined(stages), held)
