"""Queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), least=0.8)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), limit=4096)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .webtext import extract

    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import mix

    out = mix(read(spark, sf_dir, "documents"), keep=0.5)
    return out.withColumns({x: F.round(x, 6) for x in ("weight", "probability", "residual")})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import fit, score

    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").cast("bigint").alias("n_passages"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import digest

    return digest(read(spark, sf_dir, "documents"), length=200)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), size=2048)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(read(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(read(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vecdedup import duplicates

    return duplicates(read(spark, sf_dir, "embeddings"), cosine=0.93)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytebpe import digests

    return digests(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(read(spark, sf_dir, "documents"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turns import damaged, structure

    return structure(damaged(read(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def _mixing_sql(keep: float = 0.5, rounds: int = 30, flatten: float = 0.7) -> str:
    """Raking unrolled, with more rounds than the tolerance needs: a CTE for each margin and round; the sampling rate from its piecewise linear equation."""
    base = """d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) + 1 AS words FROM documents),
b AS (SELECT doc_id, source, lang, CASE WHEN n = 0 THEN 'empty' WHEN words < 50 THEN 'notes' WHEN (n - length(translate(t, '#$%&*+/<=>@[]^_{|}~', ''))) * 10 > n THEN 'marked' WHEN (n - length(replace(t, chr(10), '')) + 1) * 12 > words THEN 'listing' ELSE 'prose' END AS topic, CASE WHEN n = 0 THEN 0 ELSE words END AS n_tokens FROM d),
w0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(1 AS DOUBLE) AS weight FROM b GROUP BY ALL), tot AS MATERIALIZED (SELECT sum(tokens) AS n FROM w0)"""
    parts, k = [base], 0
    for m in ("source", "lang", "topic"):
        parts.append(f"g_{m} AS MATERIALIZED (SELECT {m}, pow(t, {flatten}) / sum(pow(t, {flatten})) OVER () AS target FROM (SELECT {m}, sum(tokens) AS t FROM w0 GROUP BY {m}) WHERE t > 0)")
    for _ in range(rounds):
        for m in ("source", "lang", "topic"):
            parts.append(f"h{k} AS MATERIALIZED (SELECT {m}, sum(tokens * weight) AS have FROM w{k} GROUP BY {m}), w{k + 1} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, tokens, weight * CASE WHEN have > 0 AND target IS NOT NULL THEN target * n / have ELSE 1 END AS weight FROM w{k} w JOIN h{k} USING ({m}) LEFT JOIN g_{m} USING ({m}), tot)")
            k += 1
    parts.append(
        f"""v AS (SELECT source, lang, topic, tokens, weight * n / (SELECT sum(tokens * weight) FROM w{k}) AS weight FROM w{k}, tot),
c AS (SELECT *, row_number() OVER o AS i, sum(tokens) OVER o AS sat, lead(weight) OVER o AS nxt FROM v WHERE tokens > 0 WINDOW o AS (ORDER BY weight DESC, source, lang, topic)), f AS (SELECT max(weight) AS top, sum(tokens * weight) AS tw FROM v WHERE tokens > 0),
s AS (SELECT *, sum(tokens * weight) OVER (ORDER BY i) AS sw FROM c), r AS (SELECT {keep} * n / tw AS rate FROM f, tot WHERE {keep} * n / tw * top <= 1 UNION ALL SELECT ({keep} * n - sat) / (tw - sw) FROM s, f, tot WHERE nxt IS NOT NULL AND ({keep} * n - sat) / (tw - sw) * nxt <= 1 AND ({keep} * n - sat) / (tw - sw) * weight > 1),
e AS ({" UNION ALL ".join(f"SELECT max(abs(have / (target * n) - 1)) AS e FROM (SELECT {m}, sum(tokens * weight) AS have FROM w{k} GROUP BY {m}) JOIN g_{m} USING ({m}), tot" for m in ("source", "lang", "topic"))}),
p AS (SELECT source, lang, topic, weight, least(1, (SELECT min(rate) FROM r) * weight) AS p FROM v)
SELECT doc_id, b.source, b.lang, b.topic, n_tokens, round(weight, 6) AS weight, round(CASE WHEN n_tokens > 0 THEN p ELSE 0 END, 6) AS probability, n_tokens > 0 AND ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / CAST(4294967296 AS DOUBLE) < p AS sampled, (SELECT round(coalesce(max(e), 0), 6) FROM e) AS residual FROM b JOIN p USING (source, lang, topic)"""
    )
    return "WITH " + ",\n".join(parts)


LINKS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x), c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.c, v.vec_id)) AS component_id, least(v.vec_id, coalesce(c.c, v.vec_id)) = v.vec_id AS kept FROM v LEFT JOIN n ON n.x = v.vec_id LEFT JOIN c ON c.x = v.vec_id"""


def oracle_sql() -> dict[str, str]:
    """SQL of those that it can express on whole tables; the others are tested against brute force."""
    return {"op4_mixing": _mixing_sql(), "op10_vector_dedup": LINKS_SQL}
