"""The registered queries of this subpackage, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_format, exact_dedup, jaccard_join, line_dedup, packing, periodic_runs, piece_coding, quality_rules, substring_dedup, suffix_dedup, toxicity, url_filter, whitening
from .shared import table


def op1_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).drop("uid", "kept_text")


def op1_line_dedup_every_line(spark, sf_dir):
    """op1 with runs of one line: every later copy of a line goes, also in documents of one or two lines."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), least=1).drop("uid", "kept_text")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("uid")


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("uid", "kept_text")


def byte_tokenizer() -> tuple:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), byte_tokenizer())


def op5_chat_format(spark, sf_dir):
    probe = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.format_conversations(turns.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string")))


def op5_chat_layouts(spark, sf_dir):
    """op5 over records of many layouts: each turn is a record of its own, with optional and unknown fields, and every fifth of no known layout."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text, kind = F.col("role"), F.col("text"), F.col("turn") % 5
    told = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    messages = F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"), F.lit("n").alias("name"))).alias("messages"), F.lit("x").alias("id")))
    shared = F.to_json(F.struct(F.array(F.struct(told.alias("from"), text.alias("value"), F.lit(1).alias("weight"))).alias("conversations"), F.lit(3).alias("score")))
    prompt = F.to_json(F.struct(F.when(role == "user", text).otherwise("").alias("prompt"), F.when(role == "assistant", text).otherwise("").alias("completion"), F.lit("y").alias("topic")))
    single = F.to_json(F.struct("role", "text"))
    record = F.when(kind == 0, single).when(kind == 1, messages).when(kind == 2, shared).when((kind == 3) & role.isin("user", "assistant"), prompt).when(kind == 3, single).otherwise(F.to_json(F.struct(text.alias("body"))))
    return chat_format.format_records(turns.select("conv_id", "turn", record.alias("record")))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), {"low_quality": "1 - quality", "toxic": "toxic"})


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Seeds: domains that are trusted, and names of domains on the block list under each of them.
TRUSTED = ("example.com", "example.net", "example.org")
BLOCKED = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op7_url_filter(spark, sf_dir):
    """Blocked are domains such as casino-win.example.com; that their subdomains are is found along the graph."""
    seeds = lambda hosts: spark.createDataFrame([(h, 1.0) for h in hosts], "host string, weight double")
    judged = url_filter.url_filter(table(spark, sf_dir, "pages"), RULES, seeds(TRUSTED), seeds([f"{b}.{t}" for b in BLOCKED for t in TRUSTED]))
    return judged.drop("trust", "distrust")  # sums of floats: their last digits depend on the order


def op8_piece_coding(spark, sf_dir):
    import public_tokenizers

    return piece_coding.piece_coding(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("uid", "component")


def op10_quality_rules(spark, sf_dir):
    """Lines are cut by count, whatever the host's size."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), share=0.0).drop("uid")


def op10_quality_rules_by_share(spark, sf_dir):
    """op10 with lines cut that a fifth of the host's distinct texts hold too."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), share=0.2).drop("uid")


def op11_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("uid", "kept")


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


def planted_periods(docs):
    """Documents of which those with crc32(doc_id) % 10 = 0 repeat a stretch of their words to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w, n, g = F.col("_w"), F.size("_w"), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    word = lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))
    planted = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    chosen = docs.withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(quality_rules.WORD), F.lit(0))))
    return chosen.withColumn("text", F.when(n > 0, planted).otherwise(F.col("text"))).drop("_w")


def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs.periodic_runs(planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_words", "n_runs", (-F.col("b.start")).alias("start"), "b.length", (-F.col("b.period")).alias("period"), F.floor(1000 * F.col("b.length") / -F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_chat_format": op5_chat_format,
    "op5_chat_layouts": op5_chat_layouts,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_piece_coding": op8_piece_coding,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_periodic_runs": op13_periodic_runs,
    "op10_quality_rules_by_share": op10_quality_rules_by_share,
    "op10_quality_rules_by_count": op10_quality_rules,
    "op1_line_dedup_every_line": op1_line_dedup_every_line,
}

ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) p FROM documents),
n AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) i, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
r AS (SELECT a.doc_id, a.i, row_number() OVER (PARTITION BY a.k, b.k, c.k ORDER BY a.doc_id, a.i) o FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN n c ON a.doc_id = c.doc_id AND c.i = a.i + 2),
gone AS (SELECT DISTINCT n.doc_id, n.p FROM n JOIN r ON n.doc_id = r.doc_id AND n.i BETWEEN r.i AND r.i + 2 WHERE o > 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) t FROM lines ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, (SELECT count(*) FROM n WHERE n.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op5_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length(t) + length(t) - length(replace(t, chr(92), '')) + len(regexp_extract_all(t, '<s>|</s>|\[INST\]|\[/INST\]')) + CASE WHEN r = 'assistant' THEN 7 ELSE 14 + length(r) END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
    "op5_chat_layouts": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations),
c AS (SELECT *, turn % 5 <> 4 AND NOT (turn % 5 = 3 AND r IN ('user', 'assistant') AND t = '') AS told FROM t)
SELECT conv_id, count_if(told)::BIGINT AS n_turns, sha256(coalesce(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn) FILTER (told), '')) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (told AND r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (told AND r = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(length(t) + length(t) - length(replace(t, chr(92), '')) + len(regexp_extract_all(t, '<s>|</s>|\[INST\]|\[/INST\]')) + CASE WHEN r = 'assistant' THEN 7 ELSE 14 + length(r) END) FILTER (told), 0)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
    # both walks as sums over paths of at most 90 links; rows under 1e-7 end a path, so cycles end too
    "op7_url_filter": r"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
refs AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?((?:https?:)?//[^"''\s>]+)', 1)) AS ref FROM p),
links AS (SELECT src, translate(regexp_extract(ref, '//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM refs),
named AS (SELECT src, dst, count(*)::DOUBLE AS w FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
hosts AS (SELECT dst AS host FROM named UNION SELECT host FROM p WHERE host <> ''),
up(src, dst) AS (SELECT host, array_to_string(string_split(host, '.')[2:], '.') FROM hosts WHERE len(string_split(host, '.')) > 2 UNION SELECT dst, array_to_string(string_split(dst, '.')[2:], '.') FROM up WHERE len(string_split(dst, '.')) > 2),
edges AS (SELECT src, dst, w FROM named UNION ALL SELECT src, dst, 1.0 FROM up),
forward AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM edges),
backward AS (SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY dst) AS share FROM edges),
good(host) AS (VALUES ('example.com'), ('example.net'), ('example.org')),
bad AS (SELECT b || '.' || host AS host FROM good, (VALUES ('adult-x'), ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) x(b)),
tw(host, s, i) AS (SELECT host, 1.0::DOUBLE / 3, 0 FROM good UNION ALL SELECT dst, 0.85 * s * share, i + 1 FROM tw JOIN forward ON src = host WHERE i < 90 AND s > 1e-7),
dw(host, s, i) AS (SELECT host, 1.0::DOUBLE / 18, 0 FROM bad UNION ALL SELECT dst, 0.85 * s * share, i + 1 FROM dw JOIN backward ON src = host WHERE i < 90 AND s > 1e-7),
t AS (SELECT host, sum(s) / (SELECT sum(s) FROM tw) AS trust FROM tw GROUP BY host), d AS (SELECT host, sum(s) / (SELECT sum(s) FROM dw) AS distrust FROM dw GROUP BY host),
rules(verdict, name, prefix) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (SELECT page_id, name || prefix AS rule, verdict FROM p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(name || prefix) DESC) = 1)
SELECT page_id, p.host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > 0.5 * (coalesce(trust, 0) + coalesce(distrust, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN t ON t.host = p.host LEFT JOIN d ON d.host = p.host""",
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) c FROM win) WHERE c > 1),
gone AS (SELECT doc_id, list_sort(list(DISTINCT p)) ps FROM (SELECT doc_id, unnest(range(i, i + 35)) p FROM rep) GROUP BY doc_id),
words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) p FROM d),
left_over AS (SELECT words.doc_id, string_agg(w[p], ' ' ORDER BY p) t, count(*) n FROM words ANTI JOIN (SELECT doc_id, unnest(ps) p FROM gone) x USING (doc_id, p) GROUP BY words.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)""",
    # two hex digits are a byte
    "op11_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
pos AS (SELECT doc_id, h, unnest(range(1, length(h), 2)) i FROM d),
w AS (SELECT doc_id, i, substr(h, i, 2) b, CASE WHEN i + 199 <= length(h) THEN substr(h, i, 200) END g FROM pos),
r AS (SELECT doc_id, i, b, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS later FROM w),
c AS (SELECT doc_id, i, b, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
k AS (SELECT doc_id, count_if(gone) AS m, count_if(opens) AS spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS t FROM s GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(m, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) g FROM d),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY ALL""",
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') k FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
FROM d WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id)""",
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
lines AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) line FROM d),
nl AS (SELECT doc_id, source, t, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) n, line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) n_dup_lines FROM nl GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT t) texts FROM nl GROUP BY source),
over_limit AS (SELECT source, k FROM (SELECT source, k, count(DISTINCT t) held FROM nl GROUP BY ALL) JOIN hosts USING (source) WHERE held > 10),
gone AS (SELECT doc_id, sum(n) g FROM nl JOIN over_limit USING (source, k) GROUP BY doc_id),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM d),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) c FROM spots),
rep AS (SELECT doc_id, count(DISTINCT p) r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM grams WHERE c > 1) GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
  coalesce(n_dup_lines, 0) n_dup_lines, coalesce(r, 0) n_repeat_words, coalesce(g, 0) n_line_words_removed
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols, n_dup_lines::BIGINT n_dup_lines, n_repeat_words::BIGINT n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_line_words_removed::BIGINT n_line_words_removed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_line_words_removed) >= 50 * n_words AS kept FROM base""",
}

ORACLE_SQL["op10_quality_rules_by_share"] = ORACLE_SQL["op10_quality_rules"].replace("WHERE held > 10", "WHERE held > 10 AND held > 0.2 * texts")
ORACLE_SQL["op10_quality_rules_by_count"] = ORACLE_SQL["op10_quality_rules"]
ORACLE_SQL["op1_line_dedup_every_line"] = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) p FROM documents),
n AS (SELECT doc_id, p, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) o FROM n) WHERE o > 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) t FROM lines ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, (SELECT count(*) FROM n WHERE n.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""
