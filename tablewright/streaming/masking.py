"""The batch masks on a stream: masking needs no state, so the same select holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.mask import mask_table, validate
from ..plans.config import Config
from ..plans.meta import SchemaMeta, TableMeta


def mask_stream(stream: DataFrame, t: TableMeta, config: Config) -> DataFrame:
    validate(SchemaMeta([t]), config)
    return mask_table(stream, t, config)


def run(stream: DataFrame, t: TableMeta, config: Config, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Masked rows to Parquet; the checkpoint folder makes a restarted stream go on where it was."""
    writer = mask_stream(stream, t, config).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
