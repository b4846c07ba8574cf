"""Corpus, vocabulary, encoding, windows and masking over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches as BA
from ..operators import corpus as CO
from ..operators import tokens as TK
from ..sources.fixtures import reviews_raw
from ..sources.tables import table
from . import sqlparts as S
from .catalog import register, stage

VOCAB = 30_000
MAX_LEN = 320
STRIDE = 64
MLM_LEN = 256
SEED = 42
BATCH = 16
SPAN = 32


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def corpus_sources(spark, sf_dir):
    return [reviews_raw(spark, sf_dir).select("seq", "text"),
            docs(spark, sf_dir).select(F.col("doc_id").alias("seq"), "text")]


CORPUS_SQL = f"""WITH {S.REVIEWS_RAW},
src AS (SELECT 0 AS src_ord, seq, {S.strip("coalesce(text, 'nan')")} AS text FROM reviews_raw
        UNION ALL
        SELECT 1, doc_id, {S.strip("coalesce(text, 'nan')")} FROM documents),
corpus AS (SELECT src_ord, seq, text FROM (SELECT *, row_number() OVER (
  PARTITION BY lower(text) ORDER BY src_ord, seq) AS rn FROM src
  WHERE length(text) > 30) WHERE rn = 1)"""


@register("corpus", f"WITH {CORPUS_SQL[5:]}\nSELECT * FROM corpus")
def corpus(spark, sf_dir):
    return CO.build_corpus(corpus_sources(spark, sf_dir))


@register("corpus_sample", f"""WITH {CORPUS_SQL[5:]}
SELECT * FROM corpus ORDER BY src_ord, seq LIMIT 100""")
def corpus_sample(spark, sf_dir):
    return CO.build_corpus(corpus_sources(spark, sf_dir), max_samples=100)


def vocab(spark, sf_dir):
    return stage(spark, sf_dir, "vocab",
                 lambda: TK.build_vocab(docs(spark, sf_dir), size=VOCAB))


def ids(spark, sf_dir):
    return stage(spark, sf_dir, "ids", lambda: TK.token_ids(
        docs(spark, sf_dir), vocab(spark, sf_dir)))


VOCAB_CTES = f"""toks AS (SELECT unnest(regexp_extract_all(lower(text), '{TK.TOKEN_RE}')) AS token
  FROM documents),
tcnt AS (SELECT token, count(*) AS count FROM toks GROUP BY token),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY count DESC, token) + 4 AS INTEGER) AS id,
  count FROM tcnt QUALIFY id < {VOCAB + 5}),
dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TK.TOKEN_RE}')) AS token,
  unnest(generate_series(1, len(regexp_extract_all(lower(text), '{TK.TOKEN_RE}')))) AS pos
  FROM documents),
dids AS (SELECT d.doc_id, coalesce(x.ids, CAST([] AS INTEGER[])) AS ids FROM documents d
  LEFT JOIN (SELECT t.doc_id, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids
             FROM dt t LEFT JOIN vocab v ON t.token = v.token GROUP BY t.doc_id) x
  ON d.doc_id = x.doc_id)"""


@register("vocabulary", f"WITH {VOCAB_CTES}\nSELECT token, id, count FROM vocab")
def vocabulary(spark, sf_dir):
    return vocab(spark, sf_dir)


def _frame_sql(body, max_len):
    b = f"list_concat([2], {body}, [3])"
    return (f"list_resize({b}, {max_len}, 0)",
            f"list_resize(list_transform({b}, lambda x: 1), {max_len}, 0)")


ENC_IDS, ENC_MASK = _frame_sql(f"list_slice(ids, 1, {MAX_LEN - 2})", MAX_LEN)


ENC_SPECIAL = (f"list_resize(list_concat([1], list_transform(list_slice(ids, 1, {MAX_LEN - 2}), "
               f"lambda x: 0), [1]), {MAX_LEN}, 1)")


@register("encoded_docs", f"""WITH {VOCAB_CTES}
SELECT doc_id, {ENC_IDS} AS input_ids, {ENC_MASK} AS attention_mask,
  {ENC_SPECIAL} AS special_tokens_mask,
  CAST(greatest(1, list_sum({ENC_MASK})) AS INTEGER) AS effective_length FROM dids""")
def encoded_docs(spark, sf_dir):
    e = TK.encode(docs(spark, sf_dir), vocab(spark, sf_dir), max_len=MAX_LEN)
    return e.withColumn("effective_length", TK.effective_length())


@register("encoded_unpadded", f"""WITH {VOCAB_CTES},
b AS (SELECT doc_id, list_concat([2], list_slice(ids, 1, {MLM_LEN - 2}), [3]) AS input_ids FROM dids)
SELECT doc_id, input_ids, list_transform(input_ids, lambda x: 1) AS attention_mask,
  list_transform(input_ids, lambda x: CAST(x IN (2, 3) AS INTEGER)) AS special_tokens_mask FROM b""")
def encoded_unpadded(spark, sf_dir):
    return TK.encode(docs(spark, sf_dir), vocab(spark, sf_dir), max_len=MLM_LEN, pad=False)


@register("token_coverage", f"""WITH {VOCAB_CTES}
SELECT lang, CAST(sum(len(ids)) AS BIGINT) AS n_tokens,
  CAST(sum(len(list_filter(ids, lambda x: x = 1))) AS BIGINT) AS n_unknown
FROM dids JOIN documents USING (doc_id) GROUP BY lang""")
def token_coverage(spark, sf_dir):
    """Words of every language that are encoded, and how many are unknown: nothing of a text is lost."""
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ids(spark, sf_dir).join(lang, "doc_id").groupBy("lang").agg(
        F.sum(F.size("ids")).alias("n_tokens"),
        F.sum(F.size(F.filter("ids", lambda x: x == 1))).alias("n_unknown"))


W = MAX_LEN - 2
STEP = max(1, W - STRIDE)
WIN_IDS, WIN_MASK = _frame_sql("chunk_ids", MAX_LEN)


def _win_ctes(w, step):
    return f"""{VOCAB_CTES},
st AS (SELECT doc_id, ids, CASE WHEN len(ids) <= {w} THEN [0] ELSE generate_series(0,
  CAST(ceil((len(ids) - {w}) / {step}) AS BIGINT) * {step}, {step}) END AS starts FROM dids),
ch AS (SELECT doc_id, ids, unnest(starts) AS s,
  unnest(generate_series(0, len(starts) - 1)) AS chunk FROM st),
win AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk,
  list_slice(ids, s + 1, s + {w}) AS chunk_ids FROM ch)"""


WIN_CTES = _win_ctes(W, STEP)


@register("sliding_windows", f"""WITH {WIN_CTES}
SELECT doc_id, chunk, chunk_ids, {WIN_IDS} AS input_ids, {WIN_MASK} AS attention_mask
FROM win""")
def sliding_windows(spark, sf_dir):
    return TK.sliding_windows(ids(spark, sf_dir), MAX_LEN, STRIDE)


@register("window_scores", f"""WITH {WIN_CTES}
SELECT doc_id, least(1.0, greatest(0.0, avg((coalesce(list_sum(chunk_ids), 0) % 97) / 96.0)))
  AS score, count(*) AS n_chunks FROM win GROUP BY doc_id""")
def window_scores(spark, sf_dir):
    w = TK.sliding_windows(ids(spark, sf_dir), MAX_LEN, STRIDE)
    s = w.select("doc_id", (F.aggregate("chunk_ids", F.lit(0).cast("long"),
                                        lambda a, x: a + x) % 97 / F.lit(96.0))
                 .alias("score"))
    return TK.document_scores(s)


def _u_sql(first, digits):
    h = (f"md5(concat_ws('|', '{SEED}', '0', CAST(doc_id AS VARCHAR), CAST(chunk AS VARCHAR), "
         f"CAST(i - 1 AS VARCHAR)))")
    return f"(CAST(CAST('0x' || substring({h}, {first}, {digits}) AS BIGINT) AS DOUBLE) / {float(16 ** digits)})"


_CHOSEN = f"(x NOT IN (0, 2, 3) AND {_u_sql(1, 13)} < 0.15)"
_REPL = (f"CASE WHEN {_u_sql(14, 9)} < 0.8 THEN 4 WHEN {_u_sql(14, 9)} < 0.9 THEN "
         f"CAST(5 + floor({_u_sql(23, 10)} * {VOCAB}) AS INTEGER) ELSE x END")
MLM_IDS, _ = _frame_sql("chunk_ids", MLM_LEN)


@register("mlm_masking", f"""WITH {_win_ctes(MLM_LEN - 2, MLM_LEN - 2)},
enc AS (SELECT doc_id, chunk, {MLM_IDS} AS input_ids FROM win)
SELECT doc_id, chunk,
  list_transform(input_ids, lambda x, i: CASE WHEN {_CHOSEN} THEN {_REPL} ELSE x END) AS masked_ids,
  list_transform(input_ids, lambda x, i: CASE WHEN {_CHOSEN} THEN x ELSE -100 END) AS labels
FROM enc""")
def mlm_masking(spark, sf_dir):
    """Examples from windows of the whole text, side by side (no overlap): every word gets its chance."""
    w = TK.sliding_windows(ids(spark, sf_dir), MLM_LEN, 0)
    return TK.mlm_mask(w, VOCAB, 0.15, SEED, 0)


_BATCH_CTES = f"""{_win_ctes(MLM_LEN - 2, MLM_LEN - 2)},
enc AS (SELECT doc_id, chunk, list_concat([2], chunk_ids, [3]) AS input_ids, len(chunk_ids) + 2 AS length FROM win),
mlm AS (SELECT doc_id, chunk, length, (length - 1) // {SPAN} AS span,
  list_transform(input_ids, lambda x, i: CASE WHEN {_CHOSEN} THEN {_REPL} ELSE x END) AS masked_ids,
  list_transform(input_ids, lambda x, i: CASE WHEN {_CHOSEN} THEN x ELSE -100 END) AS labels FROM enc),
placed AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY
  md5(concat_ws('|', '{SEED}', '0', CAST(doc_id AS VARCHAR), CAST(chunk AS VARCHAR))), doc_id, chunk) - 1 AS place FROM mlm),
dealt AS (SELECT *, place // {BATCH} AS batch, CAST(place % {BATCH} AS INTEGER) AS slot,
  max(length) OVER (PARTITION BY span, place // {BATCH}) AS width FROM placed),
steps AS (SELECT span, batch, row_number() OVER (ORDER BY
  md5(concat_ws('|', '{SEED}', '0', CAST(span AS VARCHAR), CAST(batch AS VARCHAR))), span, batch) - 1 AS step
  FROM (SELECT DISTINCT span, batch FROM dealt)),
batched AS (SELECT step, slot, CAST(width AS INTEGER) AS width, CAST(length AS INTEGER) AS length, doc_id, chunk,
  list_resize(masked_ids, width, 0) AS masked_ids, list_resize(labels, width, -100) AS labels,
  list_resize(list_transform(masked_ids, lambda x: 1), width, 0) AS attention_mask
  FROM dealt JOIN steps USING (span, batch))"""


def batched(spark, sf_dir):
    def build():
        w = TK.sliding_windows(ids(spark, sf_dir), MLM_LEN, 0, pad=False)
        masked = TK.mlm_mask(w, VOCAB, 0.15, SEED, 0)
        return BA.padded_batches(masked, ["doc_id", "chunk"], {"masked_ids": TK.PAD_ID, "labels": -100}, BATCH, SPAN, SEED, 0)
    return stage(spark, sf_dir, "mlm_batches", build)


@register("mlm_batches", f"WITH {_BATCH_CTES}\nSELECT * FROM batched")
def mlm_batches(spark, sf_dir):
    """The masked examples of whole texts in batches of about equal length, padded to the longest of each."""
    return batched(spark, sf_dir)


@register("mlm_padding", f"""WITH {_BATCH_CTES},
r AS (SELECT count(*) AS n_rows, count(DISTINCT step) AS n_batches, CAST(sum(length) AS BIGINT) AS n_tokens,
  CAST(sum(width) AS BIGINT) AS n_cells FROM batched)
SELECT *, 1 - n_tokens / n_cells AS padding_share, 1 - n_tokens / (n_rows * {MLM_LEN}) AS padding_share_fixed FROM r""")
def mlm_padding(spark, sf_dir):
    """Padding in these batches, and in the same examples at a fixed length."""
    return BA.padding_report(batched(spark, sf_dir), MLM_LEN)
