"""Registered queries of the numbered operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ocrspark.llm import (
    bpe, centroid_clusters, chat_format, decontaminate, embedding_dedup, line_dedup, minhash_dedup, pivot_search, quality,
    resharding, spelling, toxicity, warc,
)
from ocrspark.llm.common import in_fifths, table
from ocrspark.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@register("op1_embedding_dedup")
def _(s, p):
    return embedding_dedup.near_duplicates(table(s, p, "embeddings"))


#: Blanks of the word contracts and the letters they lower-case, as DuckDB expressions.
BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    "op2_line_dedup",
    f"""with lines as (
        select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as no
        from documents),
    keyed as (select *, {LOWER_SQL.format(f"trim(line, {BLANK_SQL})")} as key from lines),
    repeated as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10)
    select doc_id, count(*)::bigint as n_lines, count(r.key)::bigint as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by no) filter (where r.key is null), '')) as kept_sha256
    from keyed k left join repeated r on k.key = r.key group by doc_id""",
)
def _(s, p):
    docs = table(s, p, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, min_docs=10, keep="none")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register("op8_minhash_dedup")
def _(s, p):
    return minhash_dedup.near_duplicates(table(s, p, "documents").select("doc_id", "text"))


@register("op3_decontaminate")
def _(s, p):
    docs = table(s, p, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(s, p, "benchmark"))


@register("op5_chat_format")
def _(s, p):
    turns = table(s, p, "conversations")
    model = chat_format.train(turns.where(~in_fifths(F.col("conv_id"))))
    return chat_format.format_chat(turns.drop("role"), model)


def _classified(s: SparkSession, p: str, operator, label: str, limit: float) -> DataFrame:
    docs, labels = table(s, p, "documents"), table(s, p, "labels")
    model = operator.train(docs, labels.where(~in_fifths(F.col("doc_id"))), label)
    return operator.score(docs.select("doc_id", "text"), model).select(
        "doc_id", in_fifths(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )


@register("op4_toxicity")
def _(s, p):
    return _classified(s, p, toxicity, "toxic", 0.5)


@register("op6_quality")
def _(s, p):
    return _classified(s, p, quality, "quality", 0.3)


@register(
    "op7_warc",
    """with p as (
        select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
    q as (select *, min(page_id) over (partition by digest) as first from p)
    select page_id, n::bigint as payload_bytes, digest as payload_digest,
           case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
           case when n >= 100 and page_id <> first then first end as refers_to
    from q""",
)
def _(s, p):
    return warc.archive(table(s, p, "pages"))


VOCABULARY = "word_bpe_49k.json"


@register("op9_bpe")
def _(s, p):
    docs = table(s, p, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY))


#: Shards the documents lie in before, and shards they are put in.
OLD_SHARDS, NEW_SHARDS = 16, 24


@register("op10_resharding")
def _(s, p):
    docs = table(s, p, "documents").select("doc_id", "text")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS))
    new = resharding.reshard(docs, scratch_dir(s, "shards"), old, NEW_SHARDS)
    return new.select(
        "doc_id", resharding.size_of(F.col("text")).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


#: Whole components of the vectors of full length, as DuckDB expressions over ``embedding``.
WHOLE_SQL = "list_transform(embedding, lambda x: floor(1024 * x::double)::bigint)"
USABLE_SQL = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _rounds_sql(k: int, rounds: int, seed: int) -> str:
    """Centroids and assignments of every round as chained tables."""
    tables = [
        f"v as materialized (select vec_id, {WHOLE_SQL} as v from embeddings where len(embedding) = 64 and {USABLE_SQL})",
        f"""c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id))::int - 1 as cluster, v as c
            from v order by sha256('{seed}:' || vec_id) limit {k})""",
    ]
    for r in range(rounds + 1):
        tables.append(
            f"""a{r} as materialized (select vec_id, any_value(v) as v, min({{'d': d, 'c': cluster}}) as best from (
                select vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
                from v, c{r}) group by vec_id)"""
        )
        if r < rounds:
            tables.append(
                f"""m{r} as materialized (select cluster, list(x order by i) as c from (
                    select best.c as cluster, i, ((sum(v[i]) - (sum(v[i]) % count(*) + count(*)) % count(*)) // count(*))::bigint as x
                    from a{r}, range(1, 65) t(i) group by 1, 2) group by cluster),
                c{r + 1} as materialized (select c{r}.cluster, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (cluster))"""
            )
    return f"""with {", ".join(tables)}
        select vec_id, best.c as cluster, best.d as distance,
               sum(best.d) over (partition by best.c)::bigint as cluster_inertia, sum(best.d) over ()::bigint as inertia,
               sha256(list_aggregate(c, 'string_agg', ',')) as centroid_sha256
        from a{rounds} join c{rounds} on cluster = best.c"""


@register("op11_centroid_clusters", _rounds_sql(8, 10, 3))
def _(s, p):
    found = centroid_clusters.cluster(table(s, p, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)
    named = [(k, ",".join(map(str, c))) for k, c in enumerate(found.centroids)]
    names = s.createDataFrame(named, "cluster int, name string").select("cluster", F.sha2("name", 256).alias("centroid_sha256"))
    rows = centroid_clusters.inertia(found).join(F.broadcast(names), "cluster")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@register("op12_spelling")
def _(s, p):
    return spelling.variants(table(s, p, "documents"), least_length=5, least_count=3, one_in=97, times=2)


@register(
    "op13_pivot_search",
    f"""with v as (select vec_id, row_number() over () as row, {WHOLE_SQL} as v from embeddings where {USABLE_SQL}),
    scored as (
        select q.vec_id as query_id, q.row, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
        from v q join v c on q.row <> c.row and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
    ranked as (select *, row_number() over (partition by query_id, row order by score desc, vec_id) as rank from scored)
    select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10""",
)
def _(s, p):
    found = pivot_search.top_products(table(s, p, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
