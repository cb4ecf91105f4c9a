"""Every operator of this package as a query over the given tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masteria.functions.theta import let
from masteria.llm import (alignment, byte_bpe, chat, exact_dedup, fingerprints, fixity, packing, periodic_runs, robust_quality,
                          secret_scan, sharding, simhash, token_count)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark, folder):
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


def op2_minimax_shards(spark, folder):
    return sharding.assign_shards(_table(spark, folder, "documents"), shards=40, overhead=16)


def op3_cost_packing(spark, folder):
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        capacity=1024, end_id=0)


def op4_merkle_fixity(spark, folder):
    """The replica is a copy in which pages that break off after their footer have a damaged last tag."""
    pages = _table(spark, folder, "pages")
    html = F.coalesce("html", F.lit(""))
    damaged = F.when(html.endswith("</footer>"), F.regexp_replace(html, "</footer>$", "</f00ter>")).otherwise(html)
    return fixity.audit(fixity.record_hashes(pages, html), fixity.record_hashes(pages, damaged))


def op5_secret_ownership(spark, folder):
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return secret_scan.scan_secrets(_table(spark, folder, "documents"), repository, owner=F.col("source"))


def op6_simhash(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents"), within=4)


def op7_token_counts(spark, folder):
    return token_count.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                                    limit=4096)


def op8_prefix_tree(spark, folder):
    """All conversations, and one whose texts hold control strings."""
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return chat.read_back(chat.prefix_packs(rows.unionByName(own), tokenizer=tokenizer), tokenizer)


def op9_robust_quality(spark, folder):
    return robust_quality.robust_quality(_table(spark, folder, "documents"))


def op10_byte_bpe(spark, folder):
    return byte_bpe.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN)


def planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth text by the checksum of its id repeats its words from some place on with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(words, i)), " ")).otherwise(F.lit(""))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, folder):
    runs = periodic_runs.periodic_runs(planted_runs(_table(spark, folder, "documents")))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    # The runs are by start, then period, so a later one is better only if it is repeated more often.
    best = F.reduce("runs", none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_merkle_fingerprints(spark, folder):
    return fingerprints.edited_fingerprints(_table(spark, folder, "documents"))


def op13_token_alignment(spark, folder):
    return alignment.token_links(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_exact_dedup, op2_minimax_shards, op3_cost_packing, op4_merkle_fixity, op5_secret_ownership, op6_simhash,
    op7_token_counts, op8_prefix_tree, op9_robust_quality, op10_byte_bpe, op11_periodic_runs, op12_merkle_fingerprints,
    op13_token_alignment)}

#: SQL over the same tables. Texts that are null count as empty.
ORACLE: dict[str, str] = {
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM t""",
    "op4_merkle_fixity": """
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS n FROM pages),
             d AS (SELECT *, regexp_replace(html, '</footer>$', '</f00ter>') AS other,
                          'WARC/1.0' || n || 'WARC-Type: response' || n || 'WARC-Target-URI: ' || url || n
                          || 'Content-Length: ' || strlen(html) || n || n AS head FROM p),
             r AS (SELECT page_id, head || html || n || n AS ours, head || other || n || n AS theirs FROM d),
             o AS (SELECT *, 'pages-' || (page_id // 1024) AS archive,
                          sum(strlen(ours)) OVER (PARTITION BY page_id // 1024 ORDER BY page_id) - strlen(ours) AS place FROM r)
        SELECT archive, CAST(place AS BIGINT) AS "offset", page_id AS record_id, sha256(ours) AS primary_sha256,
               sha256(theirs) AS replica_sha256, 'corrupt' AS state
        FROM o WHERE ours <> theirs""",
    "op8_prefix_tree": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
                   UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
             e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'),
                       '(<\|turn\|>|<\|end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>)', '\1_', 'g')) AS n FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(8 + length(role) + 1 + n + 8)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op12_merkle_fingerprints": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS sha,
                          length(coalesce(text, '')) AS n FROM documents),
             o AS (SELECT *, coalesce(lead(r) OVER w, first_value(r) OVER w) AS next_r FROM d
                   WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, sha DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
             e AS (SELECT o.r, o.next_r, o.doc_id, o.n, o.text, left(o.text, o.n - o.n // 3) || left(x.text, o.n // 3) AS edited
                   FROM o JOIN d x ON x.r = o.next_r),
             v AS (SELECT r, 0 AS k, text AS t FROM e UNION ALL SELECT r, 1, edited FROM e),
             p0 AS (SELECT r, k, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ps FROM v),
             p AS (SELECT r, k, unnest(ps) AS para, generate_subscripts(ps, 1) AS pi FROM p0),
             w0 AS (SELECT r, k, pi, regexp_extract_all(para, '[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+') AS ws FROM p),
             w AS (SELECT r, k, pi, unnest(ws) AS word, generate_subscripts(ws, 1) AS wi FROM w0),
             c AS (SELECT *, coalesce(sum((md5(word) < '3')::INT) OVER (PARTITION BY r, k, pi ORDER BY wi
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ci FROM w),
             g AS (SELECT r, k, pi, ci, string_agg(word, '' ORDER BY wi) AS piece FROM c GROUP BY ALL),
             h AS (SELECT r, k, pi, ci, sha256(piece) AS hash, substr(sha256(piece), 1, 11)
                          || printf('%04x', least(length(piece), 65535)) AS digits FROM g),
             ph AS (SELECT r, k, pi, sha256(string_agg(hash, '' ORDER BY ci)) AS hash, string_agg(digits, '' ORDER BY ci) AS digits
                    FROM h GROUP BY ALL),
             pb AS (SELECT ph.*, regexp_full_match(p.para, '[\x20\x09-\x0D]*') OR ph.hash[1] = '0' AS closes
                    FROM ph JOIN p USING (r, k, pi)),
             ps AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY r, k ORDER BY pi
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS si FROM pb),
             s AS (SELECT r, k, si, sha256(string_agg(hash, '' ORDER BY pi)) AS hash,
                          string_agg(substr(hash, 1, 16) || '=' || digits, ',' ORDER BY pi) AS parts FROM ps GROUP BY ALL),
             f AS (SELECT r, k, sha256(coalesce(string_agg(hash, '' ORDER BY si), '')) || ';'
                          || coalesce(string_agg(substr(hash, 1, 16) || ',' || parts, ';' ORDER BY si), '') AS fp
                   FROM v LEFT JOIN s USING (r, k) GROUP BY ALL),
             u AS (SELECT DISTINCT r, k, digits FROM h),
             m AS (SELECT r, k, sum(('0x' || substr(digits, 12, 4))::BIGINT) AS n FROM u GROUP BY ALL),
             z AS (SELECT e.r, b.k, sum(('0x' || substr(a.digits, 12, 4))::BIGINT) AS n
                      FROM e JOIN u a ON a.r = e.r AND a.k = 0
                      JOIN u b ON b.digits = a.digits AND (b.r = e.r AND b.k = 1 OR b.r = e.next_r AND b.k = 0)
                      GROUP BY ALL)
        SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, fa.fp AS fingerprint, fb.fp AS edited_fingerprint,
               CASE WHEN ma.n IS NULL AND mb.n IS NULL THEN 1.0
                    ELSE 2.0 * coalesce(x.n, 0) / (coalesce(ma.n, 0) + coalesce(mb.n, 0)) END::DOUBLE AS near_edited,
               CASE WHEN ma.n IS NULL AND mc.n IS NULL THEN 1.0
                    ELSE 2.0 * coalesce(y.n, 0) / (coalesce(ma.n, 0) + coalesce(mc.n, 0)) END::DOUBLE AS near_next
        FROM e JOIN f fa ON fa.r = e.r AND fa.k = 0 JOIN f fb ON fb.r = e.r AND fb.k = 1
        LEFT JOIN m ma ON ma.r = e.r AND ma.k = 0 LEFT JOIN m mb ON mb.r = e.r AND mb.k = 1
        LEFT JOIN m mc ON mc.r = e.next_r AND mc.k = 0
        LEFT JOIN z x ON x.r = e.r AND x.k = 1 LEFT JOIN z y ON y.r = e.r AND y.k = 0""",
}
