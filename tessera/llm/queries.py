"""Queries of the corpus operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontaminate, lines, minhash, mixing, nearest, pii, quality, runs, sharding, suffix, tokens, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = common.staged(_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.count_words(F.col("text")).alias("size")), "sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"))


def op3_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents"), min_chars=1)


def op4_shard_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.interleave(rows, 40, tie=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"CAST(size(filter(pii, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


PLANTED_TEXT = "\\### Assistant: </turn> ok"


def op6_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text"))
    chats = chat.read_chats(chat.format_chats(chat.turns_from_rows(table.unionByName(more))))
    lost = chats.withColumn("_loss", chat.loss_text(F.col("formatted"), F.col("loss")))
    return lost.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user and assistant text of each conversation, written as JSON records of five layouts with further keys,
    and read back by the fingerprints of their paths."""
    table = _table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    both = table.groupBy("conv_id").agg(first("user").alias("u"), first("assistant").alias("a")).where("u IS NOT NULL AND a IS NOT NULL")
    u, a, lit = F.col("u.text"), F.col("a.text"), F.lit
    turn = lambda r, role, t, text: F.struct(lit(role).alias(r), text.alias(t), lit("x").alias("name"))
    records = [
        F.struct(F.array(turn("role", "user", "content", u), turn("role", "assistant", "content", a)).alias("messages"), lit(1).alias("id")),
        F.struct(F.array(turn("from", "human", "value", u), turn("from", "gpt", "value", a)).alias("conversations"), lit("s").alias("origin")),
        F.struct(u.alias("prompt"), a.alias("completion"), lit("s").alias("split")),
        F.struct(u.alias("instruction"), lit("").alias("input"), a.alias("output"), F.struct(lit(1).alias("k")).alias("meta")),
        F.struct(u.alias("prompt"), a.alias("response")),
    ]
    record = F.to_json(records[-1])
    for k, r in enumerate(records[:-1]):
        record = F.when(F.pmod("conv_id", lit(len(records))) == k, F.to_json(r)).otherwise(record)
    turns = chat.turns_from_json(both.select("conv_id", record.alias("record")))
    return turns.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("chars"))


def op7_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes("base")).alias("base_failed"), quality.passes("v1").alias("kept"), "rule_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of policy v2: documents it fails, those that only it fails, and those kept without it."""
    return quality.ablation(quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")), "v2")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.new_path(spark, "tokens")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), out, tokenizer_path())
    return tokens.read_tokens(spark, out)


def op11_find_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    words, h = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumns({"_h": h, "_g": F.floor(h / 10), "_w": F.when(h % 10 == 0, words)}).withColumn("_n", F.size("_w"))
    times = 3 + F.col("_g") % 8
    start = (F.col("_g") % F.col("_n")).cast("int")
    period = (1 + F.floor((F.col("_n") - start) / times)).cast("int")
    planted = F.when(F.col("_n") > 0, runs.replayed(F.col("_w"), start, period, times.cast("int"))).otherwise(F.col("text"))
    found = runs.find_runs(docs.select("doc_id", planted.alias("text")))
    best, line = F.col("strongest_run"), lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix_sources": op2_mix_sources,
    "op3_dedup_lines": op3_dedup_lines,
    "op4_shard_interleaved": op4_shard_interleaved,
    "op5_find_pii": op5_find_pii,
    "op6_format_chats": op6_format_chats,
    "chat_records": chat_records,
    "op7_remove_repeats": op7_remove_repeats,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality_rules": op9_quality_rules,
    "quality_ablation": quality_ablation,
    "op10_token_files": op10_token_files,
    "op11_find_runs": op11_find_runs,
    "op12_nearest_vectors": op12_nearest_vectors,
    "op13_whiten_embeddings": op13_whiten_embeddings,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
_DOC_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _mix_sql() -> str:
    """Targets by water-filling, quotas of permuted blocks by their words, then the single documents, step by step."""
    steps = ["q0 AS (SELECT k, rest, q, []::BIGINT[] AS m FROM quota)"]
    for i in range(mixing.FITS + 1):
        last = i == mixing.FITS
        pick = "arg_min(struct_pack(s := size, h := h), struct_pack(d := abs(size - rest), h := h))" if last else "arg_max(struct_pack(s := size, h := h), struct_pack(s := size, h := h))"
        steps.append(f"""b{i} AS (SELECT q{i}.k, {pick} AS x FROM q{i} JOIN d ON d.k = q{i}.k WHERE size > 0 AND place >= q AND NOT list_contains(m, h) AND {"size < 2 * rest" if last else "size <= rest"} GROUP BY q{i}.k),
q{i + 1} AS (SELECT q{i}.k, rest - coalesce(x.s, 0) AS rest, q, CASE WHEN x IS NULL THEN m ELSE list_append(m, x.h) END AS m FROM q{i} LEFT JOIN b{i} USING (k))""")
    return f"""
WITH d AS (SELECT *, ((h % {mixing.BLOCKS}) * {mixing.STRIDE} + {mixing.SHIFT}) % {mixing.BLOCKS} AS place FROM (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS k, source,
    len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents)),
src AS (SELECT k, n, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w, row_number() OVER (ORDER BY source IS NULL, source) AS i FROM (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS n FROM d GROUP BY k)),
lev AS (SELECT *, coalesce(sum(3 * n) OVER o, 0)::BIGINT AS capped, (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS heavy, sum(n) OVER ()::BIGINT AS total FROM src
    WINDOW o AS (ORDER BY 3 * n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT *, row_number() OVER (ORDER BY 3 * n / w, i) AS o, (total - capped) * w / heavy <= 3 * n AS is_free FROM lev),
cut AS (SELECT total - capped AS l, heavy AS h, o FROM free WHERE is_free ORDER BY o LIMIT 1),
tgt AS (SELECT k, n, CASE WHEN free.o >= cut.o THEN l * w / h ELSE 3.0 * n END::DOUBLE AS target FROM free, cut),
wh AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END::BIGINT AS whole FROM tgt),
re AS (SELECT *, floor(target)::BIGINT - whole * n AS rest0 FROM wh),
run AS (SELECT k, place, sum(w) OVER (PARTITION BY k ORDER BY place) AS s FROM (SELECT k, place, sum(size)::BIGINT AS w FROM d GROUP BY k, place)),
quota AS (SELECT re.k, whole, rest0 - coalesce(max(s), 0)::BIGINT AS rest, coalesce(max(run.place) + 1, 0) AS q FROM re LEFT JOIN run ON run.k = re.k AND s <= rest0 GROUP BY re.k, whole, rest0),
{", ".join(steps)}
SELECT doc_id, size, n AS source_size, target, (size * (whole + (place < q AND whole < 3)::BIGINT + list_contains(m, h)::BIGINT))::BIGINT AS taken
FROM d JOIN re USING (k) JOIN q{mixing.FITS + 1} USING (k)"""


SQL = {
    "op1_decontaminate": f"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_DOC_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_DOC_WORD}') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM dw),
hit AS (SELECT p.doc_id, p.s, win.m, win.item_id FROM pos p JOIN lens l ON p.s + l.m - 1 <= len(p.w)
        JOIN win ON win.m = l.m AND win.k = array_to_string(p.w[p.s:p.s + l.m - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_mix_sources": _mix_sql(),
    "op6_format_chats": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{PLANTED_TEXT}' FROM range(2) r(i)),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>')) + 12 AS piece FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(piece)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "chat_records": """
WITH t AS (SELECT conv_id, role, arg_min(coalesce(text, ''), struct_pack(t := turn, x := coalesce(text, ''))) AS text FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id, role)
SELECT conv_id, CASE role WHEN 'user' THEN 0 ELSE 1 END::BIGINT AS turn, role, sha256(text) AS text_sha256, length(text)::BIGINT AS chars FROM t
WHERE conv_id IN (SELECT conv_id FROM t GROUP BY conv_id HAVING count(*) = 2)""",
    "op7_remove_repeats": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, {2 * suffix.LENGTH})) AS h FROM (SELECT doc_id, x, unnest(range(0, n - {suffix.LENGTH} + 1)) AS i FROM d WHERE n >= {suffix.LENGTH})),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
cut AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {suffix.LENGTH} AS new FROM hit),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + {suffix.LENGTH} AS hi FROM (SELECT doc_id, i, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM cut) GROUP BY doc_id, r),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM runs),
kept AS (SELECT doc_id, sum(hi - lo)::BIGINT AS gone, count(*) AS spans, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(b), w.doc_id)) AS component_id, w.doc_id <= coalesce(min(b), w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = w.doc_id GROUP BY w.doc_id""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(s, s + 5)) AS x FROM dup) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > 5 * word_chars)::INT
  + 8 * (n_lines >= 5 AND 100 * n_dup_lines > 70 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 40 * n_words)::INT AS rule_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (rule_bits & 3) <> 0 AS base_failed, (rule_bits & 15) = 0 AS kept, rule_bits::INT AS rule_bits FROM b""",
    "op11_find_runs": rf"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS text, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
w AS (SELECT doc_id, xor(crc, 4294967295) AS h, xor(crc, 4294967295) // 10 AS g, regexp_extract_all(text, '{_WORD}') AS w FROM c),
a AS (SELECT *, g % len(w) AS a, 1 + (len(w) - g % len(w)) // (3 + g % 8) AS p FROM w),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM a),
k AS (SELECT doc_id, i, len(w) AS n, array_to_string(w[i + 1:i + 5], ' ') AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) > 4)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, max(i) + 5 + q - min(i) AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
t AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), struct_pack(e := -length / period, s := start, p := period)) AS b,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed, list(struct_pack(lo := start + period, hi := start + length)) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.p::BIGINT AS period, floor(1000 * b.l / b.p)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN spans IS NULL THEN w ELSE list_filter(w, lambda x, i: len(list_filter(spans, lambda z: i > z.lo AND i <= z.hi)) = 0) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id)""",
    "op12_nearest_vectors": """
WITH v AS (SELECT vec_id, max(embedding) AS e FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(q.e, b.e), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS score FROM v q JOIN v b ON q.vec_id <> b.vec_id AND len(q.e) = len(b.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) WHERE rank <= 20""",
}
_RULES = ", ".join(f"('{r}', {quality.BIT[r]})" for r in quality.POLICIES["v2"])
SQL["quality_ablation"] = f"""
SELECT rule, sum((rule_bits & {quality.mask("v2")} & bit <> 0)::BIGINT)::BIGINT AS failed, sum((rule_bits & {quality.mask("v2")} = bit)::BIGINT)::BIGINT AS failed_alone,
  sum((rule_bits & {quality.mask("v2")} IN (0, bit))::BIGINT)::BIGINT AS kept_without FROM ({SQL["op9_quality_rules"]}) CROSS JOIN (VALUES {_RULES}) v(rule, bit) GROUP BY rule"""
