"""The tracker in slots by entity name: an upsert or a batch of edits rewrites the slots of the entities it names, and no other.

A version is published by its head, a file that is written last; readers see the newest published one, whole. A writer
claims the next version by creating a file that must not exist yet, so of two writers that began with the same version one
is refused before it has written anything, and no update is lost.
"""
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from refreshgate import schemas
from refreshgate.operators import tracker as tracker_ops
from refreshgate.sources.slots import SlotStore, delete, numbers


class ConcurrentUpdate(RuntimeError):
    """Another writer has claimed the version that this one would have written."""


@dataclass(frozen=True)
class TrackerStore:
    path: str
    n_slots: int

    @property
    def slots(self) -> SlotStore:
        return SlotStore(f"{self.path}/rows", schemas.TRACKER, "entity_name", self.n_slots)

    def version(self, spark: SparkSession) -> int:
        """The newest published version, -1 before the first."""
        return max(numbers(spark, f"{self.path}/heads", "version"), default=-1)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """All rows as of a published version, the newest if none is given."""
        upto = self.version(spark) if version is None else version
        return self.slots.read(spark, list(range(self.n_slots)), upto + 1)

    def _create(self, spark: SparkSession, name: str) -> bool:
        """Create a file under the store; False if it is there already."""
        file = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return file.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(file)

    def _commit(self, spark: SparkSession, base: int, rows: DataFrame) -> int:
        """Write `rows`, whole slots, as the version after `base`."""
        new = base + 1
        if self.version(spark) != base or not self._create(spark, f"claims/version={new}"):
            raise ConcurrentUpdate(f"version {new} is another writer's")
        self.slots.write(rows, new)
        self._create(spark, f"heads/version={new}")
        return new

    def give_up(self, spark: SparkSession) -> None:
        """Take back what a writer that died before it published has written, and then its claim, so that the next one may
        go on. Readers have never seen any of it."""
        dead = self.version(spark) + 1
        for slot in range(self.n_slots):
            delete(spark, f"{self.slots.path}/slot={slot}/version={dead}")
        delete(spark, f"{self.path}/claims/version={dead}")

    def change(self, named: DataFrame, change: Callable[[DataFrame], DataFrame], base: int | None = None) -> int:
        """Replace the rows in the slots of `named` (entity_name) by `change` of them; the new version.

        `base` is the version that the caller has decided on, by default the newest. An entity that `change` renames has
        to be named by both names.
        """
        spark = named.sparkSession
        base = self.version(spark) if base is None else base
        touched = self.slots.slots_of(named)
        return self._commit(spark, base, change(self.slots.read(spark, touched, base + 1)))

    def upsert(self, incoming: DataFrame, today: str, user: str, base: int | None = None) -> int:
        """`operators.tracker.upsert` of incoming rows, in their slots; the new version."""
        return self.change(incoming, lambda rows: tracker_ops.upsert(rows, incoming, today, user), base)


def create_store(tracker: DataFrame, path: str, n_slots: int) -> TrackerStore:
    """A store with the rows of `tracker` as version 0."""
    store = TrackerStore(path, n_slots)
    store._commit(tracker.sparkSession, -1, tracker.select(*schemas.TRACKER_COLUMNS))
    return store
