"""The queries of this subpackage, as __spark_entry__.py registers them, and their DuckDB SQL where there is some."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontam, jaccard, license, lm, media, merkle, mixing, pieces, suffix, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_frames(media.store_texts(table(spark, sf_dir, "documents")))
    cells = lambda f: F.array_join(F.filter(F.transform(f["histogram"], lambda n, i: F.when(n > 0, F.concat_ws("=", i, n))), F.isnotnull), ",")
    feature = F.concat_ws("|", F.transform("frames", lambda f: F.concat_ws(":", f["start_cs"], f["delay_cs"], f["width"], f["height"], cells(f))))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, length(samples) - 63, 64)")).alias("tail_crc32"),
        F.length("gif").cast("long").alias("media_bytes"),
        F.sha2("gif", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents")).drop("text_hash", "group_digest")


def op5_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.read_back(chat.expand(turns)))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("found", lambda f: f["confirmed"])
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_named"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda f: f["paragraph"].cast("string")), ",").alias("paragraphs"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda f: f["probability"])), F.lit(0.0)), 6).alias("best_probability"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proven = merkle.manifest(table(spark, sf_dir, "documents"), shown={"text": tampered})
    return proven.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.fold(F.col("shown"), F.col("proof")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded")
    return read.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    rows = codes.with_label_error(coded).select("vec_id", "code", "error", "label_error")
    return rows.withColumn("codebooks_sha256", F.lit(codes.books_digest(books)))


def queries() -> dict:
    return {
        "op1_gif_media": op1_gif_media,
        "op2_lm_score": op2_lm_score,
        "op3_mix_sources": op3_mix_sources,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_prefix_targets": op5_prefix_targets,
        "op6_spaced_seeds": op6_spaced_seeds,
        "op7_license_scan": op7_license_scan,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_token_counts": op10_token_counts,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_piece_round_trip": op12_piece_round_trip,
        "op13_vector_codes": op13_vector_codes,
    }


SQL_MIX = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id AS k, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([1, 2, 3][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
level(i, lv) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT i + 1, (SELECT (sum(source_size) - 3 * coalesce(sum(source_size) FILTER (3.0::DOUBLE * source_size < lv * weight), 0))::DOUBLE
                        / sum(weight) FILTER (NOT 3.0::DOUBLE * source_size < lv * weight) FROM sources)
  FROM level WHERE i < 60),
targets AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, lv * weight) AS target,
         CASE WHEN source_size > 0 THEN CAST(floor(least(source_size * 3.0::DOUBLE, lv * weight) / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM sources, (SELECT coalesce(max(lv), 0) AS lv FROM level)),
run AS (
  SELECT d.k, d.source, d.size, t.source_size, t.target, t.whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size, d.k ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, whole + CASE WHEN upto - size / 2.0::DOUBLE <= target - whole * source_size AND size > 0 AND target > whole * source_size THEN 1 ELSE 0 END AS repeats FROM run)
SELECT k AS doc_id, source, size, source_size, target, CAST(repeats AS BIGINT) AS repeats, CAST(repeats * size AS BIGINT) AS taken FROM taken
"""

SQL_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
made AS (
  SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back,
         23 + length(regexp_replace(regexp_replace(replace(role, '\', '\\'), '(<)(\||/s>|s>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g'))
            + length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '(<)(\||/s>|s>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g')) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
upto AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS whole FROM made)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(whole) FILTER (role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars
FROM upto GROUP BY conv_id
"""


# op4: all pairs by their common shingles, and what the links reach by a closure
SQL_LINKS = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b, c = p.n AND c = q.n AS same FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 5 * c >= 4 * (p.n + q.n - c)),
rep AS (SELECT doc_id, least(doc_id, coalesce(min(b) FILTER (same), doc_id)) AS rep FROM d LEFT JOIN l ON a = doc_id GROUP BY doc_id),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a)
SELECT d.doc_id, any_value(class_id) AS class_id, count(l.b) AS n_links, 1 + count(*) FILTER (same) AS copies, count(DISTINCT rep) FILTER (NOT same) AS n_texts
FROM d JOIN class ON class.a = d.doc_id LEFT JOIN l ON l.a = d.doc_id LEFT JOIN rep ON rep.doc_id = l.b GROUP BY d.doc_id
"""


def _sql_seeds(side: str) -> str:
    return " UNION ALL ".join(
        f"SELECT id, pos, {m} AS mask, array_to_string([{', '.join(f'ws[pos + {o + 1}]' for o in mask)}], ' ') AS seed FROM (SELECT id, ws, unnest(range(len(ws) - {decontam.SPAN - 1})) AS pos FROM {side} WHERE len(ws) >= {decontam.SPAN})"
        for m, mask in enumerate(decontam.MASKS)
    )


# op6: seeds as texts, and the best run of an alignment among all of its runs
SQL_OVERLAPS = rf"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS ws FROM documents),
i AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS ws FROM benchmark),
ds AS ({_sql_seeds("d")}), bs AS ({_sql_seeds("i")}),
hit AS (SELECT DISTINCT ds.id AS doc, bs.id AS item, ds.pos - bs.pos AS shift FROM ds JOIN bs USING (mask, seed)),
line AS (SELECT doc, item, shift, greatest(0, -shift) AS low, list_transform(range(greatest(0, -shift), least(len(i.ws), len(d.ws) - shift)), lambda k: i.ws[k + 1] = d.ws[k + shift + 1]) AS e
  FROM hit JOIN d ON d.id = doc JOIN i ON i.id = item),
head AS (SELECT *, unnest(range(len(e))) AS a FROM line), run AS (SELECT *, unnest(range(a, len(e))) AS b FROM head),
scored AS (SELECT doc, item, shift, low, a, b, len(list_filter(e[a + 1:b + 1], lambda x: x)) AS n FROM run),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, item, shift ORDER BY n + {decontam.MISS} * (b - a + 1 - n) DESC, b, a DESC) AS k FROM scored) WHERE k = 1 AND n >= {decontam.MIN_EQUAL} AND n >= {decontam.MIN_SHARE} * (b - a + 1))
SELECT doc AS doc_id, item AS item_id, low + a + shift AS doc_start, low + a AS item_start, b - a + 1 AS n_words, n AS n_equal
FROM (SELECT *, row_number() OVER (PARTITION BY doc, item ORDER BY n DESC, low + a + shift, low + a DESC, b - a DESC) AS j FROM best) WHERE j = 1
"""

# op8: a digest of every window, of bytes and of words, and the runs that the repeated ones cover
SQL_REPEATS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, ' ' || regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', ' ', 'g') || ' ' AS z FROM documents),
p AS (SELECT doc_id, c, substr(x, 2 * c + 1, 1798) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2, 500)) AS c FROM d)),
w AS (SELECT doc_id, c + j AS i, hash(substr(y, 2 * j + 1, 800)) AS m FROM (SELECT doc_id, c, y, unnest(range(0, least(500, len(y) // 2 - 399))) AS j FROM p WHERE len(y) >= 800)),
r AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM k GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS last, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(range(len(ts))) AS k, unnest(list_transform(ts, lambda t: octet_length(encode(t)))) AS n FROM (SELECT doc_id, string_split(z, ' ') AS ts FROM d)),
word AS (SELECT doc_id, a, a + n AS b FROM (SELECT doc_id, n, CAST(coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM tok) WHERE n > 0),
reach AS (
  SELECT doc_id, lag(a, 1, 0) OVER o AS lo, a AS hi, lead(b, 50) OVER o + 1 AS e FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, coalesce(max(a), 0), any_value(octet_length(encode(z))), NULL FROM d LEFT JOIN word USING (doc_id) GROUP BY doc_id),
part AS (SELECT doc_id, lo, hi, e, hex(encode(z)) AS y FROM reach JOIN d USING (doc_id)),
piece AS (SELECT doc_id, lo, e, substr(y, 2 * lo + 1, 2 * (hi - lo + 400)) AS y, unnest(range(hi - lo)) AS j FROM part),
win AS (SELECT doc_id, lo + j AS i, least(400, coalesce(e - lo - j, 400)) AS size, coalesce(e - lo - j, 401) <= 400 AS by_words, substr(y, 2 * j + 1, 2 * least(400, coalesce(e - lo - j, 400))) AS v FROM piece),
fit AS (SELECT doc_id, i, size, by_words, hash(v) AS m FROM win WHERE len(v) = 2 * size),
span AS (
  SELECT doc_id, greatest(0, i - 1) AS a, i - 1 + size - CASE WHEN by_words THEN 1 ELSE 0 END AS b FROM fit WHERE m IN (SELECT m FROM fit GROUP BY m HAVING count(*) > 1)
  UNION ALL SELECT doc_id, i, i + 400 FROM r),
inner_ AS (SELECT doc_id, a, least(b, len(x) // 2) AS b FROM span JOIN d USING (doc_id)),
over_ AS (SELECT doc_id, a, b, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM inner_),
passages AS (SELECT doc_id, sum(greatest(0, b - greatest(a, coalesce(upto, 0)))) AS n FROM over_ GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, CAST(coalesce(passages.n, 0) AS BIGINT) AS n_repeated,
       sha256(unhex(CASE WHEN cut.n IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN passages USING (doc_id)
"""


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


# op11: levels by a recursion over the nodes, proofs by another over each leaf's ancestors; crc32 bit by bit
SQL_MERKLE = f"""
WITH RECURSIVE checked AS (
  SELECT *, list_reduce(list_transform(string_split(regexp_replace(hex(encode(CAST(doc_id AS VARCHAR))), '(..)', '\\1,', 'g'), ','), lambda b: CASE WHEN b = '' THEN NULL ELSE CAST('0x' || b AS BIGINT) END),
    lambda c, b: CASE WHEN b IS NULL THEN c ELSE list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)) END, 4294967295) AS crc FROM documents),
leaves AS (
  SELECT doc_id, source, sha256({" || ".join(map(_field, merkle.FIELDS))}) AS h,
         sha256({" || ".join(map(_field, merkle.FIELDS[:-1]))} || {_field("CASE WHEN crc % 2 = 1 THEN replace(text, chr(10), '') ELSE text END")}) AS shown FROM checked),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h, shown) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
low(level, source, n, i, h) AS (
  SELECT 0, source, n, i, h FROM placed
  UNION ALL SELECT level + 1, source, (n + 2) // 3, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY level, source, n, i // 3),
subs AS (SELECT source, h, level AS depth, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, n, i, h) AS (
  SELECT 0, n, i, h FROM subs
  UNION ALL SELECT level + 1, (n + 2) // 3, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, n, i // 3),
node AS (
  SELECT low.level, low.source, subs.i AS tree, low.i, low.h FROM low JOIN subs ON low.source IS NOT DISTINCT FROM subs.source WHERE low.n > 1
  UNION ALL SELECT subs.depth + high.level, subs.source, subs.i, high.i, high.h FROM high, subs WHERE high.n > 1),
near AS (SELECT a.level, a.tree, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM node a JOIN node b ON a.level = b.level AND a.tree = b.tree AND a.i // 3 = b.i // 3 GROUP BY ALL),
walk(level, k, tree, depth, spot, i, acc, proof) AS (
  SELECT 0, p.doc_id, s.i, s.depth, p.i, p.i, p.shown, '' FROM placed p JOIN subs s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT w.level + 1, w.k, w.tree, w.depth, w.spot, CASE WHEN w.level + 1 = w.depth THEN w.tree ELSE x.i // 3 END, sha256(x.before || w.acc || x.after), w.proof || x.before || x.after
  FROM walk w JOIN near x ON x.level = w.level AND x.tree = w.tree AND x.i = CASE WHEN w.level = w.depth THEN w.tree ELSE w.i END),
ended AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY tree, spot ORDER BY level DESC) = 1)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = r.h AS verified
FROM placed p JOIN subs s ON p.source IS NOT DISTINCT FROM s.source JOIN ended e ON e.tree = s.i AND e.spot = p.i CROSS JOIN (SELECT h FROM high WHERE n = 1) r
"""


def _sql_codes() -> str:
    """op13: every round assigns all parts anew and sums all of them."""
    parts, entries = codes.PARTS, codes.ENTRIES
    near = "arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT v.k, v.part, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN {b} b ON v.part = b.part) GROUP BY k, part"
    ctes = [f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096.0::DOUBLE * x) AS BIGINT)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"v AS MATERIALIZED (SELECT k, part, ints[part * (len(ints) // {parts}) + 1 : (part + 1) * (len(ints) // {parts})] AS x FROM kept, range({parts}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, k - 1 AS e, x FROM v WHERE k <= {entries})"]
    for r in range(codes.ROUNDS):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT k, part, {near.format(b=f'b{r}')})")
        ctes.append(f"""s{r} AS (SELECT part, e, list(m ORDER BY j) AS x FROM (SELECT part, e, j, CAST((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
  FROM (SELECT part, e, unnest(x) AS c, unnest(range(len(x))) AS j FROM a{r} JOIN v USING (k, part)) GROUP BY part, e, j) GROUP BY part, e)""")
        ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(s.x, b.x) AS x FROM b{r} b LEFT JOIN s{r} s USING (part, e))")
    return f"""WITH {", ".join(ctes)},
final AS (SELECT k, part, {near.format(b=f"b{codes.ROUNDS}")}),
coded AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY k)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM b{codes.ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mix_sources": SQL_MIX,
        "op4_ngram_jaccard": SQL_LINKS,
        "op5_prefix_targets": SQL_CHAT,
        "op6_spaced_seeds": SQL_OVERLAPS,
        "op8_suffix_dedup": SQL_REPEATS,
        "op11_merkle_manifest": SQL_MERKLE,
        "op13_vector_codes": _sql_codes(),
    }
