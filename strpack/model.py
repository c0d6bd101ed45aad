"""Training and encoding entry points."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import Archive
from .config import Config, UntrainedModelError
from .matching import Matcher
from .operators import codec
from .operators.sampling import training_sample
from .training import train_tokens


@dataclass
class Model:
    """A reusable dictionary. fit learns it (and replaces an earlier one); encode applies it to any DataFrame."""

    config: Config = field(default_factory=Config)
    tokens: tuple[bytes, ...] = ()
    mode: str = ""

    @property
    def trained(self) -> bool:
        return bool(self.tokens)

    def fit(self, df: DataFrame, value: str, order_by: Sequence[str], mode: str = "auto") -> Model:
        """Learn from a bounded, deterministic sample of the column; the result depends on values and order only."""
        rows, self.mode = training_sample(df, value, order_by, self.config, mode)
        tokens, _ = train_tokens(rows, self.config, self.config.pair_threshold(sum(map(len, rows))))
        self.tokens = tuple(tokens)
        return self

    def _need(self) -> tuple[bytes, ...]:
        if not self.tokens:
            raise UntrainedModelError("the model is not trained")
        return self.tokens

    def transform(self, df: DataFrame, value: str, out: str = codec.TOKENS) -> DataFrame:
        """df with the value column replaced by its token ids; streaming DataFrames too."""
        return codec.encode(df, value, self._need(), self.config.max_token_length, out)

    def encode(self, df: DataFrame, value: str) -> Archive:
        return Archive(self.transform(df, value), self._need(), self.config.bits, value, df.drop(value))

    def encode_literal(self, value: str | bytes) -> list[int]:
        data = value.encode() if isinstance(value, str) else value
        return Matcher(self.config.max_token_length, self._need()).parse(data)

    def dictionary_df(self, spark: SparkSession) -> DataFrame:
        return codec.dictionary(spark, self._need())

    def save(self, spark: SparkSession, path: str) -> None:
        c = self.config
        table = self.dictionary_df(spark).coalesce(1)
        for name in ("threshold", "max_token_id", "max_token_length", "token_bits", "sample_bytes", "stratified", "max_clusters"):
            table = table.withColumn(f"config_{name}", F.lit(getattr(c, name)))
        table.withColumn("mode", F.lit(self.mode)).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        rows = spark.read.parquet(path).orderBy("token_id").collect()
        head = rows[0].asDict()
        config = Config(**{k[len("config_") :]: v for k, v in head.items() if k.startswith("config_")})
        return Model(config, tuple(bytes(r.token) for r in rows), head["mode"])


def train(df: DataFrame, value: str, order_by: Sequence[str], mode: str = "auto", **options) -> Model:
    return Model(Config(**options)).fit(df, value, order_by, mode)


@dataclass(frozen=True)
class Encoder:
    """Train on a column and encode the same column."""

    config: Config = field(default_factory=Config)

    def with_options(self, **options) -> Encoder:
        return Encoder(replace(self.config, **options))

    def encode(self, df: DataFrame, value: str, order_by: Sequence[str], mode: str = "auto") -> Archive:
        return Model(self.config).fit(df, value, order_by, mode).encode(df, value)
