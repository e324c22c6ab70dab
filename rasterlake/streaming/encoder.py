"""Images coded as they arrive: the codec is stateless per image, so a stream needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.codec import encode
from ..operators.quantise import Params


def encode_stream(images: DataFrame, path: str, checkpoint: str, params: Params = Params()) -> StreamingQuery:
    """Code a stream of (image_id, side, pixels) that is there by now into Parquet containers under ``path``."""
    coded = encode(images, params)
    return coded.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
