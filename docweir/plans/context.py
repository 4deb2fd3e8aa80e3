"""What a pipeline needs besides its stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame

if TYPE_CHECKING:
    from docweir.sources.collections import CollectionStore

KEY = "_key"


@dataclass
class Context:
    """store: named collections; stores: others by (connection, database).

    mode "final" gives one row a group, "changelog" one row a change of a group's state, in the order of order_by.
    With carry, $group, $bucket and $count go on from the state that earlier inputs left in their collection (_collection,
    or one named by the app and the stage), and tell the groups that this input changed. batch is the number of a
    micro-batch, so that one that is run again comes to the same state.
    With strict_nulls a null is the least value for $min; otherwise $min passes over it.
    strict rejects unknown stages and accumulators; otherwise they are passed over. stages and functions are the
    caller's own; a built-in stage wins over one of the same name. What stages send aside (topics, deletions, probes)
    is handed to sink(kind, name, frame), or kept in `sides`.
    """

    store: CollectionStore | None = None
    stores: dict[tuple[str, str], CollectionStore] = field(default_factory=dict)
    app: str = "app"
    mode: str = "final"
    order_by: str | None = None
    strict: bool = True
    strict_nulls: bool = False
    carry: bool = False
    batch: int | None = None
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    stages: dict[str, Callable] = field(default_factory=dict)
    scripts: dict[str, Callable] = field(default_factory=dict)
    transport: Callable | None = None
    sink: Callable[[str, str, DataFrame], None] | None = None
    trace: bool = False
    sides: list[tuple[str, str, DataFrame]] = field(default_factory=list)

    def aside(self, kind: str, name: str, frame: DataFrame) -> None:
        if self.sink is not None:
            self.sink(kind, name, frame)
        else:
            self.sides.append((kind, name, frame))

    def collections(self) -> CollectionStore:
        if self.store is None:
            raise ValueError("this stage needs a store of collections")
        return self.store
