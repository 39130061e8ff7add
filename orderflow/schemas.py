"""Data model: orders with nested articles, phase steps, phase events, documents."""

from __future__ import annotations

from pyspark.sql import types as T

# Production phases, order states and defaults.
PHASES = ["LASER", "PIEGA", "SALDATURA", "PULIZIA", "SPEDIZIONE"]
DEFAULT_PHASES = ["LASER", "PIEGA", "SALDATURA"]
RECEIVED = "RICEVUTO"
SHIPPED = "SPEDITO"
COMPLETED_MESSAGE = "Ordine completato"
UNKNOWN_CLIENT = "Sconosciuto"

START, COMPLETE, COMPLETE_PARTIAL = "start", "complete", "complete_partial"

ARTICLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("qty", T.DoubleType()),
        T.StructField("required_phases", T.ArrayType(T.StringType())),
    ]
)

ORDER_REQUEST = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("cliente", T.StringType()),
        T.StructField("data_consegna", T.StringType()),
        T.StructField(
            "articles",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("code", T.StringType()),
                        T.StructField("qty", T.StringType()),
                        # A list, or one string of words parted by blanks.
                        T.StructField("required_phases", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("required_phases", T.ArrayType(T.StringType())),
        T.StructField("preventivo_minuti", T.IntegerType()),
        T.StructField("note", T.StringType()),
    ]
)

PHASE_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("phase", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("article_indices", T.ArrayType(T.IntegerType())),
        T.StructField("operator", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
