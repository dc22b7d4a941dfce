"""The registered queries of this subpackage, and SQL for those another engine can check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from qualframe.llm import chat, language, licenses, line_dedup, merkle, near_dedup, negatives, neighbours, packing, quality, sharding, tokens, toxicity
from qualframe.llm.common import stored, table

SHARDS = 24


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a word, the first line of its class, and whether it is that line."""
    found = line_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("key").alias("doc_id"), F.col("at").cast("bigint").alias("line"), F.col("first.key").alias("class_doc_id"),
        F.col("first.at").cast("bigint").alias("class_line"), F.expr("first.key <=> key AND first.at = at AND first.body = body").alias("kept"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    decoded = tokens.decode(tokens.encode(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_tokens", tokens.ids_digest(F.col("ids")).alias("ids_sha256"),
                          F.sha2("bytes", 256).alias("decoded_sha256"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, own or inherited along source and language as directories."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, F.concat_ws("/", docs["source"], docs["lang"]))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labelled documents outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.fit(*toxicity.sample_features(table(spark, sf_dir, "documents"), labels.where(~language.in_part(labels["doc_id"], 4, 2))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", language.in_part(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def added_tokens() -> dict[str, int]:
    """Of the published tokenizer whose vocabulary the rank file holds."""
    return packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), added=added_tokens())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, with the verdict of the default policy."""
    judged = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    bits = F.col("fail_bits")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (bits.bitwiseAND(F.lit(quality.mask(quality.POLICIES["base"])).cast("bigint")) != 0).alias("base_failed"),
        quality.passes(quality.DEFAULT_POLICY).alias("kept"), "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every rule of every version of the policy: documents it fails, documents only it rejects, documents kept with and without it."""
    judged = stored(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).select("fail_bits"), "fail-bits")
    parts = [quality.ablations(judged, policy).select(F.lit(policy).alias("policy"), "rule", "failed", "only_by_it", "kept", "kept_without") for policy in quality.POLICIES]
    return reduce(DataFrame.unionByName, parts)


OP1_SQL = r"""
WITH RECURSIVE lines AS (SELECT doc_id, p - 1 AS pos, trim(l, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS l
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)
    WHERE trim(l, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) <> ''),
firsts AS (SELECT l, length(l) AS n, min({'d': doc_id, 'a': pos}) AS f, row_number() OVER (ORDER BY min({'d': doc_id, 'a': pos})) AS i FROM lines GROUP BY l),
links AS (SELECT x.i AS a, y.i AS b FROM firsts x JOIN (SELECT *, unnest([n - 2, n - 1, n, n + 1, n + 2]) AS m FROM firsts WHERE n >= 24) y ON x.n = y.m
    WHERE x.n >= 24 AND x.i <> y.i AND levenshtein(x.l, y.l) <= 2),
reach AS (SELECT a AS i, b AS j FROM links UNION SELECT r.i, k.b FROM reach r JOIN links k ON r.j = k.a),
leaders AS (SELECT i, min(j) AS j FROM reach GROUP BY i)
SELECT s.doc_id, s.pos::BIGINT AS line, c.f.d AS class_doc_id, c.f.a::BIGINT AS class_line, c.f.d = s.doc_id AND c.f.a = s.pos AS kept
FROM lines s JOIN firsts o USING (l) LEFT JOIN leaders e ON o.i = e.i JOIN firsts c ON c.i = least(o.i, coalesce(e.j, o.i))
"""

OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, i, w FROM (SELECT r, unnest(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w,
    generate_subscripts(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> ''), 1) AS i FROM docs)),
windows AS (SELECT r, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
starts AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM starts) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
counted AS (SELECT r, count(*) AS n, sum(length(w)) AS chars FROM words GROUP BY r),
m AS (SELECT d.doc_id, coalesce(w.n, 0) AS n_words, coalesce(w.chars, 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
    coalesce(l.n, 0) AS n_lines, coalesce(p.n, 0) AS n_repeat_words
    FROM docs d LEFT JOIN counted w USING (r) LEFT JOIN lines l USING (r) LEFT JOIN repeats p USING (r)),
bits AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT
    + 8 * (word_chars > 12 * n_words)::INT + 16 * (10 * n_symbols > n_words)::INT + 32 * (10 * n_dup_lines > 3 * n_lines)::INT AS f FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, (f & 3) <> 0 AS base_failed, (f & 27) = 0 AS kept,
    f::BIGINT AS fail_bits FROM bits
"""

ABLATIONS_SQL = f"""
WITH ledger AS ({OP8_SQL.strip()}),
p(policy, rules) AS (VALUES ('base', 3), ('2024-1', 27), ('2024-2', 63)),
r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('short_words', 4), ('long_words', 8), ('many_symbols', 16), ('repeated_lines', 32))
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS failed, count(*) FILTER (fail_bits & rules = bit) AS only_by_it,
    count(*) FILTER (fail_bits & rules = 0) AS kept, count(*) FILTER (fail_bits & (rules - bit) = 0) AS kept_without
FROM ledger, p, r WHERE rules & bit <> 0 GROUP BY policy, rule
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~language.in_part(docs["doc_id"], 5, 0)))
    return language.identify(docs, model).select("doc_id", language.in_part(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 contiguous shards of nearly equal bytes."""
    cut = sharding.shards(table(spark, sf_dir, "documents"), SHARDS)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf with its proof; where 7 divides the crc32 of the id, the proof is asked about a changed row."""
    docs = table(spark, sf_dir, "documents")
    changed = merkle.leaf([docs[c] + 1 if c == "n_chars" else docs[c] for c in LEAF])
    asked = F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0, changed)
    found = merkle.manifest(docs.withColumn("changed", asked), LEAF, carry=["changed"])
    folded = found.withColumn("folded", merkle.fold(F.coalesce("changed", "leaf"), F.col("segment")))
    digests = [merkle.as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return folded.select("doc_id", *digests, merkle.as_hex(merkle.proof_digest(F.col("segment"))).alias("proof_sha256"),
                         merkle.as_hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


OP11_SQL = r"""
WITH RECURSIVE rows AS (SELECT doc_id, lang, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text],
        lambda v: coalesce(concat(strlen(v)::VARCHAR, ':', v), '-')) AS f, list_transform([doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text],
        lambda v: coalesce(concat(strlen(v)::VARCHAR, ':', v), '-')) AS g,
    list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
        lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295) AS crc FROM documents),
hashed AS (SELECT doc_id, lang, sha256(array_to_string(f, '')) AS leaf, xor(crc, 4294967295) % 7 = 0 AS odd, sha256(array_to_string(g, '')) AS changed FROM rows),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (SELECT lang, 0 AS level, pos, leaf AS digest, n FROM leaves
    UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, pos, digest, n FROM subroots
    UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (SELECT l.lang, l.pos, k.level, coalesce(concat(CASE WHEN (l.pos >> k.level) % 2 = 0 THEN 'R' ELSE 'L' END, s.digest), '') AS mark
    FROM leaves l JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) k ON l.lang IS NOT DISTINCT FROM k.lang
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = k.level AND s.pos = xor(l.pos >> k.level, 1)),
own AS (SELECT lang, pos, list(mark ORDER BY level) AS marks FROM steps GROUP BY lang, pos),
high AS (SELECT b.lang, b.digest AS subroot, list(coalesce(concat(CASE WHEN (b.pos >> k.level) % 2 = 0 THEN 'R' ELSE 'L' END, s.digest), '') ORDER BY k.level)
        FILTER (k.level IS NOT NULL) AS marks
    FROM subroots b LEFT JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) k ON true LEFT JOIN tops s ON s.level = k.level AND s.pos = xor(b.pos >> k.level, 1)
    GROUP BY b.lang, b.digest),
proofs AS (SELECT l.doc_id, l.leaf, h.subroot, (SELECT digest FROM tops WHERE n = 1) AS root, CASE WHEN odd THEN coalesce(changed, leaf) ELSE leaf END AS asked,
    list_concat(coalesce(o.marks, []), coalesce(h.marks, [])) AS marks
    FROM leaves l LEFT JOIN own o ON l.lang IS NOT DISTINCT FROM o.lang AND l.pos = o.pos JOIN high h ON l.lang IS NOT DISTINCT FROM h.lang),
folds AS (SELECT *, list_reduce(marks, lambda a, m: sha256(CASE m[1:1] WHEN 'L' THEN concat(m[2:], a) WHEN 'R' THEN concat(a, m[2:]) ELSE a END), asked) AS folded_root
    FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(marks, lambda m: m[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folds
"""

SAID = "\\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and one whose texts quote a template; all figures are read back from the formatted text."""
    quoting = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(turn).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(SAID).alias("text"))
        for turn, role in enumerate(("user", "assistant"))])))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(quoting)
    made = chat.formatted(turns).select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"),
                                        chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
                       F.length("learned").cast("bigint").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


OP12_SQL = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before,
    length(text) + length(text) - length(replace(text, chr(92), '')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
    + (2 * length(text) - length(replace(text, '</turn>', '')) - length(replace(text, '</part>', ''))) // 7 AS n
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY i)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n + CASE WHEN role = before THEN 7 ELSE length(role) + 14 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten hard negatives for each of the five best positives of every row whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(rows["vec_id"] % 7 == 0, (rows["label"] + 1) % 10).otherwise(rows["label"])
    return negatives.mine(rows, rows["vec_id"] % 100 == 0, label)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS alike, c.vec_id, list_dot_product(a.e, c.e)::BIGINT AS score
    FROM v a JOIN v c ON len(a.e) = len(c.e) AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, p.vec_id AS positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_byte_bpe, op3_neighbours, op4_minhash_dedup, op5_license_scan, op6_toxicity, op7_packing, op8_quality_rules, op9_language_id, op10_byte_shards, op11_merkle_manifest, op12_chat_format, op13_hard_negatives, quality_ablations)}
SQL = {"op1_line_dedup": OP1_SQL.strip(), "op8_quality_rules": OP8_SQL.strip(), "op11_merkle_manifest": OP11_SQL.strip(),
       "op12_chat_format": OP12_SQL.strip(), "op13_hard_negatives": OP13_SQL.strip(), "quality_ablations": ABLATIONS_SQL.strip()}


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
