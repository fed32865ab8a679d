"""Deal documents in XML (SRC7, SRC8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Position of the deal fields in a document, and the tags that are dropped.
DEAL_PATH = "/*/*[2]/*[1]/*[2]/*[1]"
DROPPED_TAGS = ("Country", "DealVisibleToOrg", "DealVisibleToUser")
DROPPED_SUBMISSION_TAGS = ("MetricData", "IsProvisional", "IsRestructured")
LIST_TAG, SUBMISSIONS_TAG, KEY_TAG, KEY = "ISIN", "Submissions", "DealCode", "dl_code"


def normalise_deal(df: DataFrame, key_tag: str = KEY_TAG) -> DataFrame:
    """Empty text becomes null and the deal key gets its name (SRC8)."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[
            (F.when(F.trim(c) != "", F.col(c)) if c in text else F.col(c)).alias(KEY if c == key_tag else c)
            for c in df.columns
        ]
    )


def with_deal_dates(df: DataFrame, col: str = "PoolCutOffDate") -> DataFrame:
    """Cut-off date, year and month of a deal row."""
    date = F.substring(F.col(col), 1, 10).try_cast("date")
    return df.withColumn("pcd", F.date_format(date, "yyyy-MM-dd")).withColumn("year", F.year(date)).withColumn("month", F.month(date))


def parse_deals(
    df: DataFrame, xml: str, fields: Sequence[str], submission_fields: Sequence[str] = ("PoolCutOffDate",), key_tag: str = KEY_TAG
) -> DataFrame:
    """One row per document text, by position in the document; namespaces are ignored (SRC7).

    The list field is joined by ``;`` and the first submission is flattened into the row.
    """
    local = lambda base, tag: f"{base}/*[local-name()='{tag}']"

    def value(tag):
        path = local(DEAL_PATH, tag)
        if tag == LIST_TAG:
            return F.array_join(F.xpath(F.col(xml), F.lit(f"{path}/*/text()")), ";")
        return F.xpath_string(F.col(xml), F.lit(path))

    keep = [f for f in fields if f not in DROPPED_TAGS and f != SUBMISSIONS_TAG]
    first = local(DEAL_PATH, SUBMISSIONS_TAG) + "/*[1]"
    submission = [
        F.xpath_string(F.col(xml), F.lit(local(first, f))).alias(f)
        for f in submission_fields
        if f not in DROPPED_SUBMISSION_TAGS
    ]
    others = [c for c in df.columns if c != xml]
    return normalise_deal(df.select(*others, *[value(f).alias(f) for f in keep], *submission), key_tag)


def read_deals(spark: SparkSession, paths: str | Sequence[str], fields: Sequence[str], **kw) -> DataFrame:
    """Deal rows of whole XML files by position; each file is one small document."""
    docs = spark.read.text(paths, wholetext=True)
    return with_deal_dates(parse_deals(docs, "value", fields, **kw))


def read_deals_by_tag(spark: SparkSession, paths: str | Sequence[str], row_tag: str, key_tag: str = KEY_TAG) -> DataFrame:
    """Deal rows by element name, for documents that hold many deals; fields follow from the data."""
    df = spark.read.format("xml").options(rowTag=row_tag, ignoreNamespace=True, inferSchema=False).load(paths)
    out = []
    for f in df.schema.fields:
        if f.name in DROPPED_TAGS or f.name.startswith("_"):
            continue
        if f.name == LIST_TAG and isinstance(f.dataType, T.StructType):
            parts = []
            for g in f.dataType.fields:
                c = F.col(LIST_TAG)[g.name]
                parts.append(c.cast("array<string>") if isinstance(g.dataType, T.ArrayType) else F.array(c.cast("string")))
            out.append(F.array_join(F.concat(*parts), ";").alias(LIST_TAG))
        elif f.name == SUBMISSIONS_TAG and isinstance(f.dataType, T.StructType):
            inner = f.dataType.fields[0]
            first = F.col(SUBMISSIONS_TAG)[inner.name]
            struct = inner.dataType
            if isinstance(struct, T.ArrayType):
                first, struct = F.get(first, 0), struct.elementType
            out += [
                first[g.name].cast("string").alias(g.name)
                for g in struct.fields
                if g.name not in DROPPED_SUBMISSION_TAGS and not g.name.startswith("_")
            ]
        else:
            out.append(F.col(f.name).cast("string").alias(f.name))
    return with_deal_dates(normalise_deal(df.select(*out), key_tag))
