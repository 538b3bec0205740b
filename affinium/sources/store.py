"""A run folder: everything one training leaves behind, as tables."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium import fixed
from affinium.functions import text as tx
from affinium.operators.encoding import EncoderState
from affinium.operators.fusion import FusionModel
from affinium.session import is_missing

SPLITS = ("train", "val", "test")


class Run:
    """Paths and typed access for one run folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, advice: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if not is_missing(missing):
                raise
            raise FileNotFoundError(f"no {name} in run '{self.path}': {advice} first") from missing

    # splits -------------------------------------------------------------
    def save_splits(self, labelled: DataFrame) -> None:
        labelled.write.mode("overwrite").partitionBy("split").parquet(f"{self.path}/splits")

    def splits(self) -> DataFrame:
        return self._read("splits", "train")

    def split(self, name: str) -> DataFrame:
        """One split; only its partition is read."""
        return self.splits().filter(F.col("split") == name).drop("split")

    def export_split(self, name: str, path: str) -> None:
        """CSV copy with comma-joined lists."""
        flat(self.split(name)).write.mode("overwrite").csv(path, header=True, escape='"')

    # fitted state ---------------------------------------------------------
    def save_encoder(self, state: EncoderState) -> None:
        state.save(f"{self.path}/encoder")

    def encoder(self) -> EncoderState:
        return EncoderState.load(self.spark, f"{self.path}/encoder")

    def save_model(self, model: FusionModel) -> None:
        model.to_frame(self.spark).write.mode("overwrite").parquet(f"{self.path}/model")

    def model(self) -> FusionModel:
        return FusionModel.from_frame(self._read("model", "train"))

    def save_text_weights(self, weights: list[float]) -> None:
        """Fitted weights of a tf-idf encoder."""
        frame = self.spark.createDataFrame([(list(map(float, weights)),)], "weights array<double>")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/text_weights")

    def text_weights(self) -> list[float]:
        return list(self._read("text_weights", "train").first()["weights"])

    # config ---------------------------------------------------------------
    def save_config(self, config: dict) -> None:
        one = self.spark.createDataFrame([(json.dumps(config),)], "value string")
        one.coalesce(1).write.mode("overwrite").text(f"{self.path}/config")

    def config(self) -> dict:
        try:
            return json.loads(self.spark.read.text(f"{self.path}/config").first()["value"])
        except AnalysisException as missing:
            if not is_missing(missing):
                raise
            raise FileNotFoundError(f"no trained run at '{self.path}': train first") from missing

    def config_frame(self) -> DataFrame:
        """The config as one typed row."""
        self.config()
        return self.spark.read.json(f"{self.path}/config").withColumn("run", F.lit(self.path))

    # index ----------------------------------------------------------------
    def save_index(self, index: DataFrame) -> None:
        """Index table, and beside it one row of its size and dimensions."""
        index.write.mode("overwrite").parquet(f"{self.path}/index")
        self.index().agg(
            F.count("*").alias("n_rows"), F.min(F.size("embedding")).alias("least_dim"),
            F.max(F.size("embedding")).alias("most_dim"),
        ).write.mode("overwrite").parquet(f"{self.path}/index_info")

    def index_info(self) -> dict:
        """Rows and dimensions as counted when the index was built."""
        return self._read("index_info", "build the index").first().asDict()

    def index(self) -> DataFrame:
        """Catalog rows with their embedding; an index without `cast` gets empty lists."""
        index = self._read("index", "build the index")
        if "cast" not in index.columns:
            index = index.withColumn("cast", F.array().cast("array<string>"))
        return index

    # evaluation -----------------------------------------------------------
    def save_evaluation(self, report: DataFrame) -> None:
        report.select("variant", "metric", "value").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/evaluation"
        )

    def evaluation(self) -> DataFrame:
        """`(run, variant, metric, value)`."""
        return self._read("evaluation", "evaluate").select(
            F.lit(self.path).alias("run"), "variant", "metric", "value"
        )


def flat(df: DataFrame) -> DataFrame:
    """List columns as comma text, for CSV."""
    return df.withColumns({name: tx.join_list(F.col(name)) for name in ("genres", "cast") if name in df.columns})


def from_flat(df: DataFrame) -> DataFrame:
    """Undo `flat` on text columns: split lists, restore the placeholder of missing people."""
    lists = {name: tx.split_list(F.col(name)) for name in ("genres", "cast") if name in df.columns}
    people = {
        name: F.coalesce(F.col(name), F.lit(fixed.MISSING)) for name in ("director", "writer") if name in df.columns
    }
    return df.withColumns(lists | people).withColumn("description", F.coalesce("description", F.lit("")))


def write_records(records: DataFrame, path: str, kind: str = "csv") -> bool:
    """Write cleaned records; nothing is written, and False returned, when empty."""
    if records.isEmpty():
        return False
    writer = records.write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True, escape='"')
    else:
        writer.parquet(path)
    return True


def append_snapshot(records: DataFrame, path: str) -> None:
    """Append raw records with their ingest time, one folder per day."""
    stamped = records.withColumn("ingest_ts", F.current_timestamp())
    dated = stamped.withColumn("ingest_date", F.to_date("ingest_ts"))
    dated.write.mode("append").partitionBy("ingest_date").parquet(path)
