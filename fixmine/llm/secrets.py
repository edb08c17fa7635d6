"""Incremental secret scans over an archive of versions, by content address.

Every version's text is a blob named by its SHA-256. The ledger is a folder that only grows: it holds the (blob, rule version)
pairs scanned so far with their findings, and a run adds the pairs that were not in it. A blob is scanned once,
however many paths hold it, and findings are joined back to all paths. The rule version is a digest of the patterns, so a
changed rule makes every pair unseen.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixmine.llm import text as X
from fixmine.llm.store import columns_for, drop, fresh_path, keep

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Kinds in the order that breaks ties of a start; those after the third are added by this scanner.
KINDS = ("assign", "access", "hex", "private_key", "jwt", "hub_token", "bearer")
_ADDED = (
    ("private_key", "-----BEGIN", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")),
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("hub_token", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("bearer", "earer ", re.compile(r"[Bb]earer [A-Za-z0-9+/_.=-]{20,}")),
)

#: The version of the rules.
RULES = hashlib.sha256("\n".join([*KINDS, _ASSIGN.pattern, "12", _ACCESS.pattern, _HEX.pattern, *(r.pattern for _, _, r in _ADDED)]).encode()).hexdigest()[:16]


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all findings, in order; ends are exclusive, in code points."""
    # a failed assignment is passed over whole, so the length is tested after the match
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for k, (_, hint, rule) in enumerate(_ADDED):
        if hint in text:
            found += [(m.start(), 3 + k, m.end()) for m in rule.finditer(text)]
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


FINDINGS = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, rules string"


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = X.buffers(batch["text"])
        whole = raw.tobytes()
        names = [hashlib.sha256(whole[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([batch["doc_id"], batch["text_hash"], pa.array(names, pa.binary())], names=["doc_id", "text_hash", "blob"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch["text"].to_pylist():
            found = scan(text or "")
            base = [f for f in found if f[1] < 3]
            out.append((*(sum(f[1] == k for f in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.record_batch([batch["blob"], *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that repeat (key, text_hash) within a task, the first: a text in very many rows is sent once a task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        new = []
        for x in zip(batch["key"].to_pylist(), batch["text_hash"].to_pylist(), strict=True):
            new.append(x not in seen)
            seen.add(x)
        yield batch if all(new) else batch.filter(pa.array(new, pa.bool_()))


def read_ledger(spark, path: str) -> DataFrame:
    """All pairs and findings that the ledger in the folder ``path`` has now; none if there is no such folder yet.

    Files are named one by one: Spark takes two reads of one folder for the same, so a plan with a read from before and one
    from after an append would shuffle or broadcast the first only and use it for both.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in store.listStatus(place)] if store.exists(place) else []
    files = sorted(x.toString() for x in found if not x.getName().startswith(("_", ".")))
    return spark.read.schema(FINDINGS).parquet(*files) if files else spark.createDataFrame([], FINDINGS)


def scan_archive(versions: DataFrame, ledger: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``versions`` (doc_id, text and any other columns).

    ledger: a folder, new or from earlier calls; the pairs in it are not scanned again, the others are added. One call at a time
    may add to a ledger; one that fails adds nothing. A null text is the empty blob. Each row gets the findings of
    its own text, also rows that repeat a doc_id or have none. An empty table gives an empty table.
    """
    spark = versions.sparkSession
    rows = columns_for(versions, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    paths = keep(rows.mapInArrow(_blobs, "doc_id long, text_hash long, blob binary"), "paths")
    known = read_ledger(spark, ledger).where(F.col("rules") == RULES)
    key = F.coalesce("doc_id", F.lit(-(2**63))).alias("key")
    # one version of each blob brings the text; counted before the join, so that a blob of very many paths is one row
    first = paths.groupBy("blob").agg(F.min(F.struct(key, "text_hash")).alias("row")).join(known.select("blob"), "blob", "left_anti")
    fresh = keep(first.select("blob", "row.*"), "fresh")
    texts = rows.select(key, "text_hash", "text").mapInArrow(_once, "key long, text_hash long, text string").join(fresh.hint("shuffle_hash"), ["key", "text_hash"])
    scanned = texts.select("blob", "text").mapInArrow(_scan, FINDINGS.removesuffix(", rules string")).dropDuplicates(["blob"])
    scanned.withColumn("rules", F.lit(RULES)).write.mode("append").parquet(ledger)
    drop(fresh)
    current = read_ledger(spark, ledger).where(F.col("rules") == RULES)
    return paths.join(current, "blob").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def scan_in_increments(versions: DataFrame, ledger: str | None = None) -> DataFrame:
    """``scan_archive`` of the lower half of the range of doc_id, then of the rest, which scans only what is new to the ledger."""
    ledger = ledger or fresh_path(versions.sparkSession, "ledger")
    ends = columns_for(versions, doc_id="long").agg(F.min("doc_id"), F.max("doc_id")).first()
    early = F.coalesce(F.col("doc_id").cast("long") <= F.lit(((ends[0] or 0) + (ends[1] or 0)) // 2), F.lit(False))
    return scan_archive(versions.where(early), ledger).union(scan_archive(versions.where(~early), ledger))
