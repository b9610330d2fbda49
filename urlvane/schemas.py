"""Record schemas shared by sources, operators and streams."""

from pyspark.sql import types as T

NAVIGATION = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("browser", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("url_host", T.StringType()),
    T.StructField("tab_id", T.LongType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("navigation_kind", T.StringType()),
    T.StructField("transition_type", T.StringType()),
    T.StructField("transition_qualifiers", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),
])

BROWSER_DETAIL = T.StructType([
    T.StructField("frameId", T.IntegerType()),
    T.StructField("tabId", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("documentId", T.StringType()),
    T.StructField("transitionType", T.StringType()),
    T.StructField("transitionQualifiers", T.ArrayType(T.StringType())),
])

ALERT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("rule", T.StructType([T.StructField("id", T.StringType())])),
    T.StructField("agent", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ip", T.StringType()),
    ])),
    T.StructField("data", T.StructType([
        T.StructField("event_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("url", T.StringType()),
    ])),
])

# Mixed-type provider fields are kept as strings.
PHISHTANK_RESPONSE = T.StructType([
    T.StructField("results", T.StructType([
        T.StructField("in_database", T.StringType()),
        T.StructField("verified", T.StringType()),
        T.StructField("valid", T.StringType()),
        T.StructField("phish_id", T.StringType()),
        T.StructField("phish_detail_page", T.StringType()),
    ])),
])

WEB_RISK_RESPONSE = T.StructType([
    T.StructField("threat", T.StructType([
        T.StructField("threatTypes", T.ArrayType(T.StringType())),
        T.StructField("expireTime", T.StringType()),
    ])),
])


def with_corrupt(schema: T.StructType, name: str = "_corrupt") -> T.StructType:
    """A copy with a column for the text that could not be decoded."""
    return T.StructType([*schema.fields, T.StructField(name, T.StringType())])
