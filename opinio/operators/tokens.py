"""Vocabulary, encoding, sliding windows and MLM masking.

The subword codec of the reference is re-aimed at word tokens: runs of
letters, marks and digits of any script in the lower-cased text. Ids come
from a vocabulary built by a distributed count. A document's token array
stays whole: while the vocabulary is within ``MAX_VOCAB`` rows its ids are
looked up by a vectorised Arrow step without a shuffle, beyond that by a
join. Windows, framing and masks are array expressions
(``sequence``/``slice``/``transform``), all JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CLS_ID, MASK_ID, N_SPECIAL, PAD_ID, SEP_ID, UNK_ID
from ..session import ship_package

TOKEN_RE = r"[\p{L}\p{M}\p{N}]+"
#: Vocabulary rows (some 50 bytes each) up to which they are sent to every task.
MAX_VOCAB = 2_000_000


def word_tokens(text_col: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_RE), 0)


def build_vocab(df: DataFrame, text_col: str = "text",
                size: int = 30000) -> DataFrame:
    """(token, id, count); ids 0-4 are special, then by count desc,
    token asc. ``groupBy(token)`` aggregates map-side first, so frequent
    words do not skew the shuffle; the top-``size`` cut is a
    TakeOrderedAndProject (the size limit is the feature)."""
    counts = (df.select(F.explode(word_tokens(text_col)).alias("token"))
                .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    top = counts.orderBy(F.desc("count"), "token").limit(int(size))
    w = Window.orderBy(F.desc("count"), "token")  # over <= size rows
    return top.select("token", (F.row_number().over(w) - 1 + N_SPECIAL)
                      .cast("int").alias("id"), "count")


def token_ids(df: DataFrame, vocab: DataFrame, id_col: str = "doc_id",
              text_col: str = "text", limit: int | None = None,
              max_vocab: int = MAX_VOCAB) -> DataFrame:
    """(id_col, ids): every word token mapped to its id (unknown -> 1).

    A null text has no tokens. ``limit`` keeps the first tokens only (the
    truncation of O70).
    """
    toks = F.coalesce(word_tokens(text_col), F.array().cast("array<string>"))
    if limit is not None:
        toks = F.slice(toks, 1, max(int(limit), 0))
    tokens = df.select(id_col, toks.alias("tokens"))
    if vocab.count() > max_vocab:
        return _ids_by_join(tokens, vocab, id_col)
    rows = vocab.select("token", "id").collect()
    known = df.sparkSession.sparkContext.broadcast(([r.token for r in rows], [r.id for r in rows]))

    def lookup(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        words, ids = known.value
        words, ids = pa.array(words, pa.string()), pa.array(ids, pa.int32())
        for b in batches:
            lists = b.column(1)
            found = pc.fill_null(pc.take(ids, pc.index_in(lists.flatten(), value_set=words)), UNK_ID)
            size = pc.fill_null(pc.list_value_length(lists), 0)
            ends = pc.cumulative_sum(size).to_pylist()
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), found)],
                                  names=[id_col, "ids"])

    ship_package(df.sparkSession)
    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return tokens.mapInArrow(lookup, schema)


def _ids_by_join(tokens: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """The same for a vocabulary of any size."""
    keyed = tokens.withColumn("_row", F.monotonically_increasing_id())
    ex = keyed.select(id_col, "_row", F.posexplode_outer("tokens").alias("pos", "token"))
    j = ex.join(vocab.select("token", F.col("id").alias("_tid")), "token", "left")
    tid = F.coalesce(F.col("_tid"), F.lit(UNK_ID))
    g = j.groupBy(id_col, "_row").agg(F.array_sort(F.collect_list(
        F.when(F.col("pos").isNotNull(), F.struct("pos", tid.alias("t"))))).alias("_p"))
    return g.select(id_col, F.transform("_p", lambda x: x["t"]).alias("ids"))


def frame(ids: Column, max_len: int, pad: bool = True):
    """[CLS] + ids + [SEP], right-padded to ``max_len``; attention mask."""
    body = F.concat(F.array(F.lit(CLS_ID)), ids, F.array(F.lit(SEP_ID)))
    n = F.size(body)
    if not pad:
        return body, F.array_repeat(F.lit(1), n)
    k = F.greatest(F.lit(0), F.lit(int(max_len)) - n)
    return (F.concat(body, F.array_repeat(F.lit(PAD_ID), k)),
            F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), k)))


def special_mask(ids: Column, max_len: int, pad: bool = True) -> Column:
    """1 on [CLS], [SEP] and padding, 0 on word tokens."""
    body = F.concat(F.array(F.lit(1)), F.transform(ids, lambda x: F.lit(0)),
                    F.array(F.lit(1)))
    if not pad:
        return body
    k = F.greatest(F.lit(0), F.lit(int(max_len)) - F.size(body))
    return F.concat(body, F.array_repeat(F.lit(1), k))


def encode(df: DataFrame, vocab: DataFrame, max_len: int = 320,
           id_col: str = "doc_id", text_col: str = "text",
           pad: bool = True) -> DataFrame:
    """O70 (pad=True) / O64 (pad=False): truncated, framed ids, attention
    mask and special-tokens mask."""
    t = token_ids(df, vocab, id_col, text_col, limit=max(max_len - 2, 0))
    ids, mask = frame(F.col("ids"), max_len, pad)
    return t.select(id_col, ids.alias("input_ids"), mask.alias("attention_mask"),
                    special_mask(F.col("ids"), max_len, pad).alias("special_tokens_mask"))


def effective_length(mask_col: str = "attention_mask") -> Column:
    """Sum of the attention mask, at least 1."""
    return F.greatest(F.lit(1), F.aggregate(F.col(mask_col), F.lit(0),
                                            lambda a, x: a + x))


def window_starts(n: Column, window: int, stride: int) -> Column:
    """Chunk start offsets: one chunk if it fits, else every ``step`` until
    a chunk reaches the end (no extra tail chunk)."""
    step = max(1, window - stride)
    last = F.ceil((n - F.lit(window)) / F.lit(step)).cast("int") * F.lit(step)
    return F.when(n <= F.lit(window), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), last, F.lit(step)))


def sliding_windows(ids_df: DataFrame, max_len: int = 320, stride: int = 64,
                    id_col: str = "doc_id", ids_col: str = "ids", pad: bool = True) -> DataFrame:
    """O72 + O73: one row per (document, chunk) with framed ids and mask;
    without ``pad`` as long as the chunk is (O64).

    window = max_len - 2, step = max(1, window - stride) (stride is the
    overlap). ``window <= 0`` degrades to one truncated chunk.
    """
    w = max_len - 2
    ids = F.col(ids_col)
    if w <= 0:
        chunks = F.array(F.array().cast("array<int>"))
    else:
        starts = window_starts(F.size(ids), w, stride)
        chunks = F.transform(starts, lambda s: F.slice(ids, s + 1, w))
    ex = ids_df.select(id_col, F.posexplode(chunks).alias("chunk", "chunk_ids"))
    fids, mask = frame(F.col("chunk_ids"), max_len, pad)
    return ex.select(id_col, "chunk", "chunk_ids", fids.alias("input_ids"),
                     mask.alias("attention_mask"))


def document_scores(chunk_scores: DataFrame, id_col: str = "doc_id",
                    score_col: str = "score") -> DataFrame:
    """Mean chunk score clipped to [0, 1] and the chunk count."""
    return chunk_scores.groupBy(id_col).agg(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(score_col)))
         .alias("score"),
        F.count(F.lit(1)).alias("n_chunks"))


def mlm_mask(enc: DataFrame, vocab_size: int, prob: float = 0.15,
             seed: int = 42, epoch: int = 0, id_cols=("doc_id", "chunk"),
             ids_col: str = "input_ids") -> DataFrame:
    """Masked-LM inputs and labels, deterministic per
    (seed, epoch, ids of the row, position).

    Non-special positions are chosen with probability ``prob``; of those
    80% become [MASK], 10% a random vocabulary id, 10% stay. ``labels`` is
    the original id where chosen, -100 elsewhere. One digest a position
    gives the three draws (52, 36 and 40 bits).
    """
    def drawn(i, first, digits):
        h = F.md5(F.concat_ws("|", F.lit(seed), F.lit(epoch), *[F.col(c).cast("string") for c in id_cols], i.cast("string")))
        return F.conv(F.substring(h, first, digits), 16, 10).cast("double") / F.lit(float(16 ** digits))

    def at(x, i):
        chosen = ~x.isin(PAD_ID, CLS_ID, SEP_ID) & (drawn(i, 1, 13) < F.lit(prob))
        other = (F.lit(N_SPECIAL) + F.floor(drawn(i, 23, 10) * F.lit(max(vocab_size, 1)))).cast("int")
        kind = F.transform(F.array(drawn(i, 14, 9)), lambda k: F.when(k < 0.8, F.lit(MASK_ID)).when(k < 0.9, other).otherwise(x))[0]
        return F.when(chosen, F.struct(kind.alias("id"), x.alias("label"))).otherwise(
            F.struct(x.alias("id"), F.lit(-100).alias("label")))

    pairs = enc.select(*id_cols, F.transform(ids_col, at).alias("_pairs"))
    return pairs.select(*id_cols, F.col("_pairs.id").alias("masked_ids"), F.col("_pairs.label").alias("labels"))
