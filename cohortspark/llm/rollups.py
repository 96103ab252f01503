"""Token counts as rollups maintained by deltas.

Method. A store is a folder with a log and one folder per attempt to commit. A batch of changes (insert, delete or
revise a document's count under a tokenizer version) is joined with the store's ledger to signed deltas: an insert
adds, a delete takes back what the ledger holds, a revision does both. The deltas are summed by source, language and
tokenizer version; totals are the sum over all batches.

A commit writes its rows and its log entry, whole, to an attempt's own folder. One exclusive step then makes the entry
visible as the log's next: a hard link on a local file system, a rename that never overwrites on HDFS, and on an object
store a conditional write, which shows nothing before it is whole. So an entry that exists is complete, none is ever
overwritten, and whoever finds the place taken starts again from the longer log; a batch that stands in the log is not
applied again. What a run that died has left behind is in no entry and counts for nothing; ``vacuum`` removes it.

Cases. Source, language and version may be null and form groups of their own. A row without doc_id cannot be found
again: its insert counts, its delete or revision is ignored. Within a batch the change with the largest ``seq`` of a
document and version wins (repeated rows are one change); deleting or revising an unknown document does nothing;
inserting a known one revises it; a null or unknown op does nothing. An empty batch commits no rows. Columns beyond
those named are not read, texts least of all.

Scale. A batch shuffles its changes and the ledger's narrow rows by document; a hot source or language only meets the
partial sums. Every ``COMPACT``-th entry writes the whole ledger and the totals, and lists the batches so far as ranges of
numbers; each entry names the last of these. A commit opens that one and the fewer than ``COMPACT`` later ones, however
long the history is; the log's end is found by doubling steps.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.shared import drop_folder

GROUP = ("source", "lang", "tokenizer_version")
#: Log entries from one snapshot to the next.
COMPACT = 8
_KEYS = ("doc_id", "tokenizer_version")
_LEDGER = "doc_id long, tokenizer_version string, source string, lang string, n_tokens long, alive boolean, entry long"
_DELTAS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


@dataclass
class Log:
    """The number of entries, that of the last snapshot (0: none), all batches as ranges, and the attempts from there on."""

    last: int
    snapshot: int
    batches: list[list[int]]
    attempts: list[str]


def with_batch(ranges: list[list[int]], batch: int) -> list[list[int]]:
    """Ranges of batch numbers, rising and apart, with one more."""
    merged: list[list[int]] = []
    for low, high in sorted([*ranges, [batch, batch]]):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = [merged[-1][0], max(high, merged[-1][1])]
        else:
            merged.append([low, high])
    return merged


class Store:
    """A rollup store below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self, name: str = "log"):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entry(self, number: int) -> str:
        return f"log/{number:08d}"

    def _exists(self, number: int) -> bool:
        return self._files().exists(self._path(self._entry(number)))

    def _open(self, number: int) -> dict:
        stream = self._files().open(self._path(self._entry(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _log(self) -> Log:
        """What the log's last snapshot says, and the entries from there on."""
        high = 1
        while self._exists(high):
            high *= 2
        low = high // 2  # exists (or is 0); high does not, and there are no gaps
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._exists(middle) else (low, middle)
        if low == 0:
            return Log(0, 0, [], [])
        last = self._open(low)
        start = last["snapshot"]
        entries = [self._open(k) for k in range(max(start, 1), low)] + [last]
        ranges = entries[0]["batches"] if start else []
        later = entries[1:] if start else entries
        for entry in later:
            ranges = with_batch(ranges, entry["batch"])
        return Log(low, start, ranges, [e["attempt"] for e in entries])

    def _enter(self, number: int, entry: dict) -> bool:
        """Make a whole log entry visible; False if another run has taken its number."""
        attempt, target = self._path(f"{entry['attempt']}/entry"), self._path(self._entry(number))
        files, text = self._files(), json.dumps(entry)
        files.mkdirs(target.getParent())
        scheme = files.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):  # an object store: a conditional write, seen when it is whole
            return self._created(files, target, text)
        if not self._created(files, attempt, text):
            raise FileExistsError(attempt.toString())
        if scheme == "file":
            try:
                os.link(attempt.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(attempt, target, options)
        except Py4JJavaError:
            if files.exists(target):
                return False
            raise
        return True

    @staticmethod
    def _created(files, path, text: str) -> bool:
        """Create a file; False if it exists, before or by the time it is closed."""
        try:
            stream = files.create(path, False)
            stream.write(bytearray(text.encode()))
            stream.close()
        except Py4JJavaError:
            if files.exists(path):
                return False
            raise
        return True

    def committed(self) -> list[int]:
        """Numbers of the committed batches."""
        return [b for low, high in self._log().batches for b in range(low, high + 1)]

    def vacuum(self, hours: float = 168) -> int:
        """Remove attempts that no reader of the log needs and that are older than so many hours; their number.

        These are those of runs that died or lost, and those before the last snapshot.
        """
        needed, before = set(self._log().attempts), (time.time() - 3600 * hours) * 1000
        gone = 0
        for status in self._files().listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith("attempt-") and name not in needed and status.getModificationTime() <= before:
                drop_folder(self.spark, f"{self.folder}/{name}")
                gone += 1
        return gone

    def _read(self, log: Log, snapshot: str, later: str, schema: str) -> DataFrame:
        """The last snapshot and what came later."""
        first = [f"{self.folder}/{log.attempts[0]}/{snapshot}"] if log.snapshot else []
        paths = first + [f"{self.folder}/{attempt}/{later}" for attempt in log.attempts[len(first) :]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _states(self, log: Log) -> DataFrame:
        return self._read(log, "snapshot", "ledger", _LEDGER)

    @staticmethod
    def _living(states: DataFrame) -> DataFrame:
        latest = states.groupBy(*_KEYS).agg(F.max_by(F.struct("source", "lang", "n_tokens", "alive", "entry"), "entry").alias("now"))
        return latest.select(*_KEYS, "now.*").where("alive")

    def ledger(self) -> DataFrame:
        """The current count of each living document and version."""
        return self._living(self._states(self._log())).drop("alive", "entry")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs and n_tokens over all committed batches."""
        return self._summed(self._read(self._log(), "totals", "deltas", _DELTAS)).where("n_docs <> 0 or n_tokens <> 0")

    @staticmethod
    def _summed(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before.

        changes: op (insert, delete, revise), seq, doc_id, tokenizer_version, source, lang, n_tokens.
        """
        while True:
            log = self._log()
            if any(low <= batch <= high for low, high in log.batches):
                return False
            attempt, number = f"attempt-{uuid.uuid4().hex}", log.last + 1
            compact = number - log.snapshot >= COMPACT
            self._write(log, f"{self.folder}/{attempt}", changes, compact)
            entry = {"batch": batch, "attempt": attempt, "snapshot": number if compact else log.snapshot}
            if compact:
                entry["batches"] = with_batch(log.batches, batch)
            if self._enter(number, entry):
                return True
            drop_folder(self.spark, f"{self.folder}/{attempt}")

    def _write(self, log: Log, folder: str, changes: DataFrame, compact: bool) -> None:
        """The ledger rows and deltas of a batch that follows ``log``, and a snapshot if asked for."""
        entry = F.lit(log.last + 1).cast("long").alias("entry")
        count = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens")
        changes = changes.where("op in ('insert', 'delete', 'revise')").select("op", "seq", *_KEYS, "source", "lang", count)
        known = changes.where("doc_id is not null").groupBy(*_KEYS).agg(
            F.max_by(F.struct("op", "source", "lang", "n_tokens"), F.struct("seq", "op", "n_tokens", "source", "lang")).alias("c")
        )
        old = self._living(self._states(log)).select(*_KEYS, F.struct("source", "lang", "n_tokens").alias("o"))
        old = old.select(F.col("doc_id").alias("k1"), F.col("tokenizer_version").alias("k2"), "o")
        both = known.join(old.hint("merge"), known.doc_id.eqNullSafe(old.k1) & known.tokenizer_version.eqNullSafe(old.k2), "left")
        # A revision may leave source and language out: the ledger's stand.
        revised = F.col("c.op") == "revise"
        new = F.struct(
            F.when(revised, F.coalesce("c.source", "o.source")).otherwise(F.col("c.source")).alias("source"),
            F.when(revised, F.coalesce("c.lang", "o.lang")).otherwise(F.col("c.lang")).alias("lang"),
            F.col("c.n_tokens").alias("n_tokens"),
        )
        gone = F.col("c.op") == "delete"
        both = both.where((F.col("c.op") == "insert") | F.col("o").isNotNull())
        both = both.select(*_KEYS, F.when(gone, F.col("o")).otherwise(new).alias("n"), "o", (~gone).alias("alive"))
        # The ledger's rows carry what they replace, so that the deltas are read from them and not computed again.
        rows = both.select(*_KEYS, "n.source", "n.lang", "n.n_tokens", "alive", entry, "o")
        rows.write.parquet(f"{folder}/ledger")
        rows = self.spark.read.schema(rows.schema).parquet(f"{folder}/ledger")
        one = F.lit(1).cast("long").alias("n_docs")
        plus = rows.where("alive").select(*GROUP, one, "n_tokens")
        minus = rows.where("o is not null").select("o.source", "o.lang", "tokenizer_version", -one, (-F.col("o.n_tokens")).alias("n_tokens"))
        nameless = changes.where("doc_id is null and op = 'insert'").select(*GROUP, one, "n_tokens")
        deltas = self._summed(plus.union(minus).union(nameless))
        deltas.write.parquet(f"{folder}/deltas")
        if compact:
            self._living(self._states(log).unionByName(rows.drop("o"))).write.parquet(f"{folder}/snapshot")
            deltas = self.spark.read.schema(_DELTAS).parquet(f"{folder}/deltas")
            self._summed(self._read(log, "totals", "deltas", _DELTAS).union(deltas)).write.parquet(f"{folder}/totals")


def changes_of(docs: DataFrame, op: str, version: str, seq: int, n_tokens: Column) -> DataFrame:
    """Rows of a change feed from documents (doc_id, source, lang, ...)."""
    return docs.select(
        F.lit(op).alias("op"),
        F.lit(seq).cast("long").alias("seq"),
        "doc_id",
        F.lit(version).alias("tokenizer_version"),
        "source",
        "lang",
        n_tokens.cast("long").alias("n_tokens"),
    )
