"""Token sequences: vocabulary, special tokens, masks, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowloom import constants as K
from flowloom.functions import arrays as X
from flowloom.operators.quantize import Codebook

VOCAB_SCHEMA = "token_id int, token string"


MAX_TOKENS = 1 << 20


class Vocabulary:
    """Special and class tokens; their ids follow the codebook ids.

    A vocabulary is a model parameter with a checked limit, so its table is kept as literal rows and may be broadcast.
    """

    def __init__(self, table: DataFrame, codebook_size: int):
        rows = sorted(tuple(r) for r in table.select("token_id", "token").limit(MAX_TOKENS + 1).collect())
        if len(rows) > MAX_TOKENS:
            raise ValueError(f"a vocabulary holds at most {MAX_TOKENS} tokens")
        self.table, self.codebook_size = table.sparkSession.createDataFrame(rows, VOCAB_SCHEMA), codebook_size
        ids = {token: token_id for token_id, token in rows}
        self.eof, self.pad, self.unk, self.bof = (ids[t] for t in K.SPECIAL_TOKENS)
        self._ids, self._tokens = ids, dict(rows)

    @classmethod
    def create(cls, spark: SparkSession, codebook_size: int, stored: dict[int, str] | None = None) -> "Vocabulary":
        """A stored id map wins over the default ids."""
        pairs = sorted(stored.items()) if stored else [(codebook_size + i, t) for i, t in enumerate(K.SPECIAL_TOKENS)]
        return cls(spark.createDataFrame([(int(i), t) for i, t in pairs], VOCAB_SCHEMA), codebook_size)

    def add_classes(self, names: DataFrame, column: str = K.TARGET_CLASS) -> "Vocabulary":
        """Unseen class names get the next ids in alphabetical order; `names` is reduced to distinct classes first."""
        new = names.select(F.col(column).alias("token")).filter("token is not null").distinct().join(
            F.broadcast(self.table.select("token")), "token", "left_anti")
        numbered = new.select(
            (F.lit(max(self._tokens)) + F.row_number().over(Window.orderBy("token"))).cast("int").alias("token_id"), "token")
        return Vocabulary(self.table.unionByName(numbered), self.codebook_size)

    def size(self) -> int:
        return self.codebook_size + len(self._tokens)

    def id_of(self, token: str) -> int:
        return self._ids[token]

    def token_of(self, token_id: int) -> str:
        return self._tokens[token_id]

    def save(self, path: str) -> None:
        self.table.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, codebook_size: int) -> "Vocabulary":
        return cls(spark.read.schema(VOCAB_SCHEMA).parquet(path), codebook_size)


def _unknown(label: str) -> Column:
    return F.raise_error(F.concat(F.lit("class is not in the vocabulary: "), F.coalesce(F.col(label), F.lit("NULL"))))


def encode_flows(
    flows: DataFrame, codebook: Codebook, vocab: Vocabulary, packets: str = "packets", label: str | None = None,
    special: bool = True, mask: bool = True, mask_first: bool = False, max_length: int = K.MAX_SEQUENCE,
) -> DataFrame:
    """Add `input_ids` (and `attention_mask`); with `label` the class token comes first, else the begin token.

    A flow whose class has no token is an error.
    """
    out = flows.withColumn("__ids", codebook.encode_flow(F.col(packets)))
    if special:
        first = F.lit(vocab.bof)
        if label is not None:
            names = vocab.table.select(F.col("token_id").alias("__first"), F.col("token").alias("__token"))
            out = out.join(F.broadcast(names), out[label] == names["__token"], "left")
            first = F.coalesce(F.col("__first"), _unknown(label).cast("int"))
        ids = X.expand_tokens(F.col("__ids"), first, vocab.eof, vocab.pad, max_length)
    else:
        ids = X.pad_tokens(F.col("__ids"), vocab.pad)
    out = out.withColumn("input_ids", ids)
    if mask:
        out = out.withColumn("attention_mask", X.attention_mask(F.col("input_ids"), vocab.pad, mask_first))
    return out.drop("__ids", "__first", "__token")


def pad_batch(encoded: DataFrame, vocab: Vocabulary, length: int) -> DataFrame:
    """Pad every sequence to one length, as sequence models need; longer sequences are an error."""
    ids = F.col("input_ids")
    fill = F.array_repeat(F.lit(vocab.pad).cast("int"), F.lit(length) - F.size(ids))
    too_long = F.raise_error(F.lit("sequence longer than the batch length")).cast("array<int>")
    padded = encoded.withColumn("input_ids", F.when(F.size(ids) <= length, F.concat(ids, fill)).otherwise(too_long))
    return padded.withColumn("attention_mask", X.attention_mask(F.col("input_ids"), vocab.pad))


def with_lm_labels(encoded: DataFrame, vocab: Vocabulary) -> DataFrame:
    return encoded.withColumn("labels", X.lm_labels(F.col("input_ids"), vocab.pad))


def decode_flows(tokens: DataFrame, codebook: Codebook, vocab: Vocabulary, column: str = "input_ids") -> DataFrame:
    """Add `packets`: special tokens removed, slots after the end token absent (NULL pairs)."""
    return tokens.withColumn("packets", codebook.decode_flow(X.strip_special(F.col(column), vocab.eof)))


def labelled_tokens(
    flows: DataFrame, codebook: Codebook, vocab: Vocabulary, encoder: DataFrame, label: str = K.TARGET_CLASS,
    keep: Sequence[str] = ("flow_id",), special: bool = True, mask_first: bool = False,
) -> DataFrame:
    """Token sequences with the class number of a fitted encoder table (class, label)."""
    encoded = encode_flows(flows, codebook, vocab, special=special, mask_first=mask_first)
    numbers = encoder.select(F.col("class").alias("__class"), "label")
    number = F.coalesce(F.col("label"), _unknown(label).cast(encoder.schema["label"].dataType))
    return encoded.join(numbers, encoded[label] == numbers["__class"], "left").select(
        *keep, "input_ids", "attention_mask", number.alias("label"))


def size_tokens(flows: DataFrame, n: int = K.PACKET_LIMIT, size_range: int = K.SIZE_TOKEN_RANGE,
                packets: str = "packets", name: str = "size_tokens") -> DataFrame:
    """First n packet sizes as positive tokens; missing packets count as size 0."""
    slots = F.sequence(F.lit(0), F.lit(n - 1))
    return flows.withColumn(name, F.transform(slots, lambda i: X.size_token(F.get(F.col(packets), i)["ps"], size_range)))
