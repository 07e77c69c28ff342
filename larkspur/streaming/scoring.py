"""Micro-batches of offers matched against a catalogue that stays as it is. Matching needs a
window by offer and a search by category, so each batch is matched as a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.prepare import OwnBrand, prepare_offers
from ..operators.rules import Thresholds
from ..plans.pipeline import match
from ..sources.scratch import temporary


def match_stream(offers: DataFrame, master: DataFrame, path: str, checkpoint: str, at: Thresholds = Thresholds(), own: OwnBrand = OwnBrand(), **trigger) -> StreamingQuery:
    """Append each batch's best candidates to Parquet at path, in a folder of the batch's number: a
    batch that runs again writes the same folder again. master is a prepared catalogue."""

    def batch(df: DataFrame, number: int) -> None:
        prepared = prepare_offers(df, own).withColumn("offer_ord", F.monotonically_increasing_id())
        ids = prepared.persist()
        with temporary():
            match(ids, master, at).join(ids.select("offer_ord", "offerid"), "offer_ord").write.mode("overwrite").parquet(f"{path}/batch={number}")
        ids.unpersist()

    return offers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
