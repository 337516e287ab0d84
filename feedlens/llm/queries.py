"""The queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_lines

    return judge_lines(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_binary import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spm import sp_encode

    return sp_encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations written as transcripts, some turns without a speaker's name, parsed and rendered; n_rows counts the rows in a turn."""
    from . import chat

    turns = chat.as_transcript(table(spark, sf_dir, "conversations"))
    model = chat.fit(turns.where(~F.coalesce(held_out("conv_id", 4, 2), F.lit(True))))
    found = chat.render(chat.parse_transcripts(turns.select("conv_id", F.col("turn").alias("place"), "text"), model))
    return found.select("conv_id", "turn", "piece", F.coalesce(held_out("conv_id", 4, 2), F.lit(True)).alias("held_out"), "role_pred", "n_lines", "n_rows", "rendered")


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every document, at places that its id and length choose."""
    from .token_count import apply_own_edits, build_state

    tokenizer = tokenizer_file("byte_bpe_50k.json")
    state = build_state(table(spark, sf_dir, "documents"), tokenizer)
    at = lambda k: F.pmod(F.crc32(F.concat_ws(":", "doc_id", F.lit(k)).cast("binary")), F.length("text") + 1).cast("int")
    edit = lambda k, remove, insert: F.struct(at(k).alias("at"), F.lit(remove).alias("remove"), F.lit(insert).alias("insert"))
    edits = F.array(edit(1, 7, ""), edit(2, 0, " and one more"), edit(3, 3, "né, 42"))
    done = apply_own_edits(state.withColumn("edits", edits), tokenizer)
    return done.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), "bytes_encoded", F.size("tree_tokens").cast("long").alias("n_cells"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    found = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(held_out("doc_id", 3, 1), F.lit(False)).alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .align import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_records

    return page_records(table(spark, sf_dir, "pages"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_embedding_dedup, op3_token_binary, op4_language_id, op5_sentencepiece, op6_chat_format, op7_token_count, op8_toxicity, op9_packing, op10_minhash, op11_alignment, op12_warc, op13_importance)
}

_WORD = "[^\\x20\\x09-\\x0D]+"
_BLANK = "[\\x20\\x09-\\x0D]"


def _quality_sql() -> str:
    from .quality import BOILERPLATE, COPYRIGHT, EMPHASIS, LEFT, LINKS, RIGHT, SEPARATORS, SYMBOLS, TERMINALS, UNMARKED, WIDE, LineRules

    r = LineRules()
    number = lambda text, chars: f"len(regexp_extract_all({text}, '[' || regexp_escape('{chars}') || ']'))"
    said = "|".join(x.replace("'", "''") for x in (*BOILERPLATE, COPYRIGHT))
    links = "|".join(x.replace(".", "\\.") for x in LINKS)
    within = lambda ranges: "len(regexp_extract_all(line, '[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]'))"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, COALESCE(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS words FROM d),
 win AS (SELECT r, i, array_to_string(words[i:i+7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
 twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
 rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY r),
 li AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
 lc AS (SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS n, NOT contains(line, '{LEFT}') AS arrows, {number('line', SEPARATORS)} AS plain_seps, {number('line', RIGHT)} AS rights, regexp_replace(line, '^{_BLANK}+', '')[1] AS lead,
  {number('line', EMPHASIS)} AS emph, {number('line', TERMINALS)} AS term, {within(WIDE)} AS wide, {within(UNMARKED)} AS bare, len(regexp_extract_all(line, '(?i){links}')) AS links, length(regexp_replace(line, '{_BLANK}', '', 'g')) AS chars FROM li),
 lu AS (SELECT *, n + wide // 2 AS units, plain_seps + CASE WHEN arrows THEN rights ELSE 0 END - CASE WHEN lead <> '' AND (contains('{SEPARATORS}', lead) OR (arrows AND lead = '{RIGHT}')) THEN 1 ELSE 0 END AS seps FROM lc),
 l1 AS (SELECT *, n > 0 AND ((seps >= {r.min_separators} AND 100 * seps >= {r.separators_per_100_words} * units) OR (seps >= 1 AND term = 0 AND units <= {r.words_per_entry + 1} * seps + {r.words_per_entry}) OR (links >= {r.min_links} AND 2 * links >= n)) AS navigation FROM lu),
 l2 AS (SELECT *, n > 0 AND NOT navigation AND ((emph >= {r.min_emphasis} AND 100 * emph > {r.emphasis_per_100_words} * units) OR (term = 0 AND bare = 0 AND (n >= {r.unpunctuated_words} OR wide >= {r.unpunctuated_wide}))) AS punctuation FROM l1),
 l3 AS (SELECT *, n > 0 AND NOT navigation AND NOT punctuation AND units <= {r.boilerplate_words} AND regexp_matches(line, '(?i){said}') AS boilerplate FROM l2),
 per AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines, count(*) FILTER (WHERE navigation) AS n_lines_navigation, count(*) FILTER (WHERE punctuation) AS n_lines_punctuation,
  count(*) FILTER (WHERE boilerplate) AS n_lines_boilerplate, CAST(COALESCE(sum(chars) FILTER (WHERE navigation OR punctuation OR boilerplate), 0) AS BIGINT) AS lost_chars FROM l3 GROUP BY r),
 c AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars, {number('t', SYMBOLS)} AS n_symbols, n_dup_lines, COALESCE(rep.n, 0) AS n_repeat_words, n_lines, n_lines_navigation, n_lines_punctuation, n_lines_boilerplate, lost_chars
  FROM w JOIN per USING (r) LEFT JOIN rep USING (r)),
 b AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeated} * n_words AS base_failed FROM c)
 SELECT *, NOT base_failed AND 100 * lost_chars <= {r.max_lost} * word_chars AS kept FROM b"""


_NEAR_VECTORS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
 reach(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT b, root FROM reach JOIN links ON id = a)
 SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT id AS vec_id, min(root) AS component_id FROM reach GROUP BY id)"""

_NEAR_TEXTS_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '{_WORD}') AS words FROM documents),
 k AS (SELECT *, CASE WHEN len(words) > 0 THEN min(doc_id) OVER (PARTITION BY words) ELSE doc_id END AS copy_of FROM w),
 s AS (SELECT doc_id, g, count(*) AS often FROM (SELECT doc_id, array_to_string(words[i:i+4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM k WHERE len(words) > 0 AND doc_id = copy_of)) GROUP BY 1, 2),
 n AS (SELECT doc_id, sum(often) AS c FROM s GROUP BY 1),
 both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.often, y.often)) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM both_ JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 5 * both_.c >= 4 * (na.c + nb.c - both_.c)),
 reach(id, root) AS (SELECT doc_id, doc_id FROM k WHERE doc_id = copy_of UNION SELECT b, root FROM reach JOIN links ON id = a),
 found AS (SELECT id, min(root) AS class_id FROM reach GROUP BY id)
 SELECT doc_id, copy_of, class_id, doc_id = class_id AS kept FROM k JOIN found ON copy_of = id"""


def _importance_sql() -> str:
    """CRC-32 is folded over a feature's bytes, by a table that SQL makes from the polynomial; each different feature is hashed once."""
    features = lambda name, key: f"""SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM {name}"""
    words = "regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents), b AS (SELECT 0 AS r, {words} AS w FROM benchmark),
 df AS ({features('d', 'r')}), bf AS ({features('b', 'r')}),
 tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
 h AS (SELECT g, xor(list_reduce(list_concat([4294967295], list_transform(range(1, 2 * strlen(g), 2), lambda i: CAST('0x' || hex(g)[i:i+1] AS BIGINT))), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT g FROM df UNION SELECT g FROM bf), tab),
 s AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (g) GROUP BY 1), u AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (g) GROUP BY 1),
 gain AS (SELECT bucket, CAST(floor(1000 * ln((COALESCE(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM df) + 10000) / ((COALESCE(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bf) + 10000)))) AS BIGINT) AS gain FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN u USING (bucket)),
 m AS (SELECT r, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM df JOIN h USING (g) JOIN gain USING (bucket) GROUP BY 1),
 x AS (SELECT doc_id, len(w) AS n_words, COALESCE(n, 0) AS n_features, COALESCE(weight, 0) AS weight, CAST('0x' || sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS e FROM d LEFT JOIN m USING (r)),
 y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((e + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
 z AS (SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id NULLS LAST) AS k FROM y)
 SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 25 * (SELECT count(*) FROM y WHERE n_words >= 20) // 100 THEN k END AS rank FROM z"""


_WARC_SQL = """WITH p AS (SELECT page_id, COALESCE(html, '') AS h, sha1(COALESCE(html, '')) AS x FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS k FROM p),
 b AS (SELECT *, list_transform(range(40), lambda i: instr('0123456789abcdef', x[i + 1]) - 1) AS d FROM f)
 SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, CASE WHEN k = 1 OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((d[5 * i // 4 + 1] * 16 + COALESCE(d[5 * i // 4 + 2], 0)) // CAST(2 ^ (3 - 5 * i % 4) AS INT)) % 32 + 1]), '') AS payload_digest FROM b"""

#: The others need tokenizers or trained models; their tests compare them with plain versions.
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _quality_sql(), "op2_embedding_dedup": _NEAR_VECTORS_SQL, "op10_minhash": _NEAR_TEXTS_SQL, "op12_warc": _WARC_SQL, "op13_importance": _importance_sql()}
