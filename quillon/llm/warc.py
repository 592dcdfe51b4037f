"""WARC archives: native writer, and a reader that verifies record boundaries by chains.

Writing: each row becomes one record of an uncompressed WARC file, one file a task, through Spark's
own text writer. Equal payloads of at least ``least`` bytes are stored once: the row with the
largest id is the response, the others are revisit records without a payload.

Reading: tasks cut the files at every occurrence of the magic line, in splits of any size, and emit
for each candidate record where its successor would start. Payloads may hold the magic line, even
whole forged records, so a candidate counts only if it is reachable from the start of its file.
Chains are first followed inside each split; pointer jumping then joins the splits' entry points,
which takes as many rounds as the logarithm of a file's number of splits.

Defined cases: a null payload is empty; a null URL has no target header, and control characters in a
URL are percent-encoded there; of equal payloads with the same largest id, or without any id, every row is a
response; repeated rows are written again each; an empty table gives an archive without records; a
file cut short loses the records from the cut on; extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import work_dir, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Groups of equal payloads are broadcast up to so many (about 60 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 100_000


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of a binary column's SHA-1, natively: five hex digits are four of base 32."""
    text = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(text, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(df: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> str:
    """Write one record for each row; returns the archive's folder."""
    rows = df.select(
        F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
    ).withColumns({"size": F.octet_length("payload"), "digest": base32_sha1(F.col("payload").cast("binary"))})
    groups = (
        rows.filter(F.col("size") >= least).groupBy("digest", "size")
        .agg(F.max("id").alias("keep"), F.count("*").alias("n")).filter("n > 1").select("digest", "size", "keep")
    )
    groups = written(groups, "warc-groups")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    revisit = (F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep")))
    clean = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), F.uuid(), F.lit(">\r\nWARC-Date: "),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), clean), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"),
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col("id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT}\r\nX-Refers-To-Page: "), F.col("keep").cast("string"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(revisit, "0").otherwise(F.col("size").cast("string")), F.lit(END),
    )
    record = F.concat(F.lit(MAGIC), head, F.when(revisit, "").otherwise(F.col("payload")))
    path = f"{work_dir(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows.join(groups, ["digest", "size"], "left").select(record.alias("value")).write.option("lineSep", END).text(path)
    return path


SEGMENT = (
    "file string, block long, rel long, bytes long, head long, body long, page_id long, type string, "
    "refers_to long, declared string, declared_bytes long, digest string"
)


#: What a revisit claims of the response it names.
CLAIM = ["page_id", "payload_bytes", "payload_digest"]


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines, with the split it was read in; in the files' order within a split."""
    return (
        spark.read.option("lineSep", MAGIC).text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    )


def _number(text: bytes | None) -> int | None:
    return int(text) if text is not None and text.strip().isdigit() else None


def parse_head(value: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """(length of the header block with its blank line, fields), or None if this is no record.

    URLs have no bound, so neither has the header.
    """
    end = value.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in value[:end].split(b"\r\n"):
        name, colon, rest = line.partition(b": ")
        if not colon:
            return None
        fields[name] = rest
    if _number(fields.get(b"Content-Length")) is None or b"WARC-Type" not in fields:
        return None
    return end + 4, fields


def base32_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment: its place in the split, what its header says, and its digest if it is whole."""
    here, rel = None, 0
    names = [x.split(" ")[0] for x in SEGMENT.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64()}[x.split(" ")[1]] for x in SEGMENT.split(", ")]
    for b in batches:
        out = []
        for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if (file, block) != here:
                here, rel = (file, block), 0
            value = value.as_py()
            row = [file, block, rel, len(value), None, None, None, None, None, None, None, None]
            if (head := parse_head(value)) is not None:
                at, f = head
                body = int(f[b"Content-Length"])
                page = f.get(b"X-Page-Id")
                whole = len(value) == at + body + len(END)
                row[4:] = [
                    at, body, int(page) if page is not None and page.lstrip(b"-").isdigit() else None, f[b"WARC-Type"].decode("utf-8", "replace"),
                    int(x) if (x := f.get(b"X-Refers-To-Page", b"")).lstrip(b"-").isdigit() else None,
                    f.get(b"WARC-Payload-Digest", b"")[5:].decode("utf-8", "replace"), _number(f.get(b"X-Payload-Length")),
                    base32_of(value[at : at + body]) if whole else None,
                ]
            out.append(row)
            rel += len(value) + len(MAGIC)
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _exits(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a split leaves the split."""
    succ = dict(zip(pdf["off"].tolist(), pdf["succ"].tolist(), strict=True))
    out: dict[int, int] = {}
    for off in sorted(succ, reverse=True):
        out[off] = out.get(succ[off], succ[off])
    return pd.DataFrame({"file": key[0], "block": key[1], "off": list(out), "exit": list(out.values())}).astype({"off": "int64", "exit": "int64"})


def _walk(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a split that its reached entry points lead to."""
    succ = dict(zip(pdf["off"].tolist(), pdf["succ"].tolist(), strict=True))
    reached, going = set(), sorted(pdf.loc[pdf["entered"], "off"].tolist())
    for off in going:
        while off in succ and off not in reached:
            reached.add(off)
            off = succ[off]
    return pd.DataFrame({"file": key[0], "off": sorted(reached)}).astype({"off": "int64"})


def reachable(nodes: DataFrame, rounds: int) -> DataFrame:
    """(file, off) of the nodes (file, block, off, succ) that the chain from offset 0 of their file visits.

    Each task holds the candidates of one split, never of a whole file.
    """
    exits = nodes.groupBy("file", "block").applyInPandas(_exits, "file string, block long, off long, exit long")
    exits = written(exits, "warc-exits")
    targets = exits.select("file", F.col("exit").alias("off")).distinct()
    entries = (
        exits.join(targets, ["file", "off"], "left_semi").unionByName(exits.filter("off = 0")).dropDuplicates(["file", "off"])
        .select("file", "off", F.col("exit").alias("ptr"), (F.col("off") == 0).alias("entered"))
    )
    for _ in range(rounds):
        # What is entered enters its pointer's end; then every pointer doubles.
        hit = entries.filter("entered").select("file", F.col("ptr").alias("off"), F.lit(True).alias("hit")).distinct()
        jump = entries.select("file", F.col("off").alias("ptr"), F.col("ptr").alias("next"))
        entries = written(
            entries.join(hit, ["file", "off"], "left").join(jump, ["file", "ptr"], "left")
            .select("file", "off", F.coalesce("next", "ptr").alias("ptr"), (F.col("entered") | F.coalesce("hit", F.lit(False))).alias("entered")),
            "warc-entries",
        )
    return (
        nodes.join(entries.filter("entered").select("file", "off", "entered"), ["file", "off"], "left")
        .withColumn("entered", F.coalesce("entered", F.lit(False)))
        .groupBy("file", "block").applyInPandas(_walk, "file string, off long")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record on the chains: page_id, type, refers_to, payload_bytes, payload_digest, verified.

    Verified are responses whose payload has the digest they declare, and revisits that name a verified response of their
    bytes and digest.
    """
    cut = written(_segments(spark, path).mapInArrow(_candidates, SEGMENT), "warc-candidates")
    blocks = cut.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("total"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = written(blocks.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total"), "warc-blocks")
    most = blocks.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    placed = cut.join(blocks, ["file", "block"]).withColumn("off", F.col("base") + F.col("rel") - len(MAGIC))
    found = placed.filter("head IS NOT NULL AND off >= 0").withColumn("succ", F.col("off") + len(MAGIC) + F.col("head") + F.col("body") + len(END))
    found = written(found, "warc-found")
    rounds = (most - 1).bit_length() + (most > 1)
    true = found.join(reachable(found.select("file", "block", "off", "succ"), rounds), ["file", "off"])
    true = written(true, "warc-true")
    split = true.filter("digest IS NULL").select("file", "off", "succ")
    if not split.isEmpty():
        # Records whose payload holds the magic line: their segments are read again and put together.
        mended = _assembled(spark, path, placed.select("file", "block", "rel", "off"), true)
        true = true.join(mended, ["file", "off"], "left").withColumn("digest", F.coalesce("digest", "whole")).drop("whole")
    revisit = F.col("type") == "revisit"
    out = true.select(
        "page_id", F.col("type").alias("record_type"), F.when(revisit, F.col("refers_to")).alias("refers_to"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("body")).alias("payload_bytes"),
        F.when(revisit, F.col("declared")).otherwise(F.col("digest")).alias("payload_digest"),
        (revisit | (F.col("digest") == F.col("declared"))).alias("verified"),
    )
    # What revisits claim, once for each response: a response that many revisit is one row here.
    named = [F.col(c).alias(f"__{c}") for c in CLAIM]
    claims = out.filter("refers_to IS NOT NULL").select(F.col("refers_to").alias("__page_id"), *named[1:]).distinct()
    false = written(claims.join(out.filter("record_type = 'response' AND verified").select(*named), [f"__{c}" for c in CLAIM], "left_anti"), "warc-false")
    if not false.isEmpty():
        wrong = false.withColumn("__wrong", F.lit(True))
        same = (F.col("refers_to") == F.col("__page_id")) & (F.col("payload_bytes") == F.col("__payload_bytes")) & (F.col("payload_digest") == F.col("__payload_digest"))
        out = out.join(wrong, same, "left").withColumn("verified", F.col("verified") & F.col("__wrong").isNull())
        out = out.drop("__wrong", *(f"__{c}" for c in CLAIM))
    return out


def _assembled(spark: SparkSession, path: str, placed: DataFrame, true: DataFrame) -> DataFrame:
    """(file, off, whole: digest) of the true records that lie in several segments."""
    starts = true.select("file", "off", F.struct("off", F.col("digest").isNull().alias("split")).alias("own"))
    marked = placed.filter("off >= 0").join(starts, ["file", "off"], "left")
    # The last true record that begins before a split: the window over a file has a row for each of its splits.
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = marked.groupBy("file", "block").agg(F.max("own").alias("own")).select("file", "block", F.max("own").over(before).alias("carried"))
    order = W.partitionBy("file", "block").orderBy("off").rowsBetween(W.unboundedPreceding, 0)
    owned = (
        marked.join(carried, ["file", "block"]).withColumn("owner", F.coalesce(F.last("own", True).over(order), "carried"))
        .filter("owner.split").select("file", "block", "rel", "off", F.col("owner.off").alias("owner"))
    )

    def located(batches):
        here, rel = None, 0
        for b in batches:
            rels = []
            for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if (file, block) != here:
                    here, rel = (file, block), 0
                rels.append(rel)
                rel += len(value.as_buffer() or b"") + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rels, pa.int64())], names=["file", "block", "value", "rel"])

    def glue(key, pdf: pd.DataFrame) -> pd.DataFrame:
        data = MAGIC.encode().join(pdf.sort_values("off")["value"].map(bytes))
        at, f = parse_head(data)
        return pd.DataFrame({"file": [key[0]], "off": [key[1]], "whole": [base32_of(data[at : at + int(f[b"Content-Length"])])]})

    raw = _segments(spark, path).mapInArrow(located, "file string, block long, value binary, rel long")
    return raw.join(owned, ["file", "block", "rel"]).groupBy("file", "owner").applyInPandas(glue, "file string, off long, whole string")
