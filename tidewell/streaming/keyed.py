"""A keyed table that batches of changes renew, and that any reader sees in one version.

Rows lie in slots by the hash of their key, one folder each. A batch is written to a log, by slot too, and costs its own size. A version is a
small file that names, for each slot, the folder that holds it, and the batches of the log that come on top; it is written last, under a new
number, and never changed. Once the log passes a share of the table, or a number of batches, the slots that it touches are
written anew and the log starts empty. Readers fold the log into the slots that it touches and take the others as they lie, so what a
read opens does not grow with the number of batches that there have been.

Changes count by ``seq``, in any order while they lie in the log; a batch with changes from before the last that was folded is refused,
since what they would have changed is no longer known.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.changes import apply_changes
from tidewell.sources.files import folder_exists, list_names, read_text, remove_folder, write_new_text

SLOT = "_tw_slot"
#: The log is folded once it has this share of the rows of the table, or so many batches.
FOLD_SHARE, FOLD_BATCHES = 0.1, 16
#: Versions whose folders stay for readers that began with them.
KEPT_VERSIONS = 3


@dataclass(frozen=True)
class Version:
    number: int
    slots: dict[int, str]
    rows: int
    log: tuple[str, ...] = ()
    log_rows: int = 0
    touched: tuple[int, ...] = ()
    last_batch: int = -1
    #: the newest change in the log, and the newest that was folded
    last_seq: int | None = None
    folded_seq: int | None = None

    def text(self) -> str:
        return json.dumps({**self.__dict__, "slots": {str(k): v for k, v in self.slots.items()}})

    @classmethod
    def parse(cls, text: str) -> "Version":
        d = json.loads(text)
        return cls(**{**d, "slots": {int(k): v for k, v in d["slots"].items()}, "log": tuple(d["log"]), "touched": tuple(d["touched"])})


@dataclass
class KeyedTable:
    """``key`` is unique in the table; a change has it, ``seq``, ``op`` and the other columns, null where not given."""

    spark: SparkSession
    root: str
    schema: T.StructType
    key: str
    seq: str = "seq"
    op: str = "op"
    n_slots: int = 64
    fold_share: float = FOLD_SHARE
    fold_batches: int = FOLD_BATCHES
    change_schema: T.StructType = field(init=False)

    def __post_init__(self):
        fields = [f for f in self.schema.fields if f.name != self.key]
        self.change_schema = T.StructType(
            [self.schema[self.key], T.StructField(self.seq, T.LongType()), T.StructField(self.op, T.StringType()), *fields]
        )

    def _slot(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.n_slots)).cast("int")

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in list_names(self.spark, f"{self.root}/versions") if n.endswith(".json"))

    def version(self) -> Version | None:
        """The newest complete version."""
        numbers = self._numbers()
        return Version.parse(read_text(self.spark, f"{self.root}/versions/{numbers[-1]}.json")) if numbers else None

    def _publish(self, version: Version) -> None:
        write_new_text(self.spark, f"{self.root}/versions/{version.number}.json", version.text())
        self._forget(version.number - KEPT_VERSIONS)

    def _forget(self, number: int) -> None:
        """Remove a version and the folders that only it and versions before it named."""
        path = f"{self.root}/versions/{number}.json"
        if number < 0 or not folder_exists(self.spark, path):
            return
        old, kept = Version.parse(read_text(self.spark, path)), [Version.parse(read_text(self.spark, f"{self.root}/versions/{n}.json")) for n in self._numbers() if n > number]
        used = {p for v in kept for p in (*v.slots.values(), *v.log)}
        for folder in {*old.slots.values(), *old.log} - used:
            remove_folder(self.spark, folder)
        remove_folder(self.spark, path)

    def _write_slots(self, rows: DataFrame, slots: list[int], columns: list[str]) -> dict[int, str]:
        """Write rows by slot to a new folder; the folder of every slot that has rows."""
        folder = f"{self.root}/rows/{uuid.uuid4().hex}"
        placed = rows.select(*columns, self._slot().alias(SLOT))
        placed.repartition(SLOT).write.partitionBy(SLOT).parquet(folder)
        names = set(list_names(self.spark, folder))
        return {s: f"{folder}/{SLOT}={s}" for s in slots if f"{SLOT}={s}" in names}

    def create(self, rows: DataFrame) -> Version:
        slots = self._write_slots(rows, list(range(self.n_slots)), self.schema.names)
        version = Version(0, slots, self._read(list(slots.values()), self.schema).count())
        self._publish(version)
        return version

    def append(self, changes: DataFrame, batch: int) -> Version:
        """Add a batch of changes; one that is there already changes nothing. Folds the log when it is due."""
        now = self.version()
        if now is None:
            raise ValueError(f"no table at {self.root}")
        if batch <= now.last_batch:
            return now
        given = changes.select(*(F.col(f.name).cast(f.dataType) for f in self.change_schema))
        slots = self._write_slots(given, list(range(self.n_slots)), self.change_schema.names)
        n, first, last = self._read(list(slots.values()), self.change_schema).agg(F.count("*"), F.min(self.seq), F.max(self.seq)).first()
        if n and now.folded_seq is not None and first <= now.folded_seq:
            for folder in {p.rsplit("/", 1)[0] for p in slots.values()}:
                remove_folder(self.spark, folder)
            raise ValueError(f"batch {batch} has changes from {first}, but the table holds those up to {now.folded_seq}")
        version = replace(
            now, number=now.number + 1, log=(*now.log, *slots.values()), log_rows=now.log_rows + n, touched=tuple(sorted({*now.touched, *slots})),
            last_batch=batch, last_seq=max((x for x in (now.last_seq, last) if x is not None), default=None),
        )
        self._publish(version)
        if version.log_rows > self.fold_share * max(1, version.rows) or self._log_batches(version) >= self.fold_batches:
            return self.fold()
        return version

    @staticmethod
    def _log_batches(version: Version) -> int:
        return len({p.rsplit("/", 1)[0] for p in version.log})

    def fold(self) -> Version:
        """Write the slots that the log touches anew; the log of the new version is empty."""
        now = self.version()
        if not now.log:
            return now
        before = self._rows(now, now.touched).count()
        slots = self._write_slots(self._folded(now), list(now.touched), self.schema.names)
        after = self._read(list(slots.values()), self.schema).count()
        kept = {s: p for s, p in now.slots.items() if s not in now.touched}
        version = Version(
            now.number + 1, {**kept, **slots}, now.rows - before + after, last_batch=now.last_batch, last_seq=now.last_seq, folded_seq=now.last_seq
        )
        self._publish(version)
        return version

    def _read(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def _rows(self, version: Version, slots) -> DataFrame:
        return self._read([version.slots[s] for s in slots if s in version.slots], self.schema)

    def _folded(self, version: Version) -> DataFrame:
        log = self._read(list(version.log), self.change_schema)
        return apply_changes(self._rows(version, version.touched), log, self.key, self.seq, self.op)

    def read(self, version: Version | None = None) -> DataFrame:
        """The table as of a version, the newest if none is named."""
        version = version or self.version()
        still = [s for s in version.slots if s not in version.touched]
        whole = self._rows(version, still)
        return whole.unionByName(self._folded(version)) if version.log else whole

    def sink(self):
        """For ``drain_batches``: every micro-batch becomes a batch of changes."""
        return lambda batch, number: self.append(batch, number)
