"""Folding the many operations of one node, streamed in order through one task.

Revisions of a node form a hash chain, so its operations can only be taken one after another. They are sorted within
partitions behind the node's state and read in batches; the state is carried from batch to batch, and each outcome leaves with its batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WHITE_SPACE = " \t\n\x0b\f\r"


class NodeState:
    """Text, revision and lifecycle of a node while its operations are taken."""

    def __init__(self, row: dict):
        self.title, self.description, self.revision, self.lifecycle = (row[k] for k in ("title", "description", "revision_uuid", "lifecycle_state"))

    def embedded(self, block: str | None) -> str | None:
        if block is None or self.description is None:
            return None
        return self.description.rstrip(WHITE_SPACE) + ("" if not self.description.strip(" ") else "\n\n") + block

    def take(self, op: dict, namespace: uuid.UUID) -> dict:
        """The outcome of one operation, which changes the state if it has no code."""
        embeds = op["operation"] == "traversal.embed"
        title = self.title if embeds or op["title"] is None else op["title"]
        description = self.embedded(op["block"]) if embeds else self.description if op["description"] is None else op["description"]
        code = None
        if op["creates"]:
            code = "pointer_exists" if self.revision is not None else None
        elif self.revision is None:
            code = "node_not_found"
        elif op["expected_revision_uuid"] not in (None, self.revision):
            code = "stale_write"
        elif None not in (title, description) and (title, description) == (self.title, self.description):
            code = "unchanged"
        previous = None if op["creates"] else self.revision
        lifecycle = self.lifecycle if not op["creates"] else "staged" if op["operation"] == "node.stage" else "promoted"
        if code is None:
            digest = "" if None in (title, description) else hashlib.sha256(f"{title}\0{description}".encode()).hexdigest()
            name = f"revision:{op['uuid']}|{op['created_at']}|{digest}|{previous or ''}"
            self.title, self.description, self.revision, self.lifecycle = title, description, str(uuid.uuid5(namespace, name)), lifecycle
        return {**op, "code": code, "title": title, "description": description, "revision_uuid": self.revision,
                "previous_revision_uuid": previous, "lifecycle_state": lifecycle}


def folded(ops: DataFrame, state: DataFrame, namespace: str, outcome: StructType) -> DataFrame:
    """``uuid, pointer`` and ``outcome`` for each of ``ops``, in the order of ``index`` on each pointer.

    ``ops`` has the operation's columns and ``uuid, created_at, creates, block``; ``state(pointer, title, description, revision_uuid,
    lifecycle_state)`` has at most one row a pointer.
    """
    import pyarrow as pa

    unknown = {"title": None, "description": None, "revision_uuid": None, "lifecycle_state": None}
    wanted = ["uuid", "pointer", *outcome.fieldNames()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        layout = to_arrow_schema(schema)
        pointer, node, space = None, NodeState(unknown), uuid.UUID(namespace)
        for batch in batches:
            done = []
            for op in batch.to_pylist():
                if op["pointer"] != pointer:
                    pointer, node = op["pointer"], NodeState(unknown)
                if op["is_state"]:
                    node = NodeState(op)
                else:
                    done.append(node.take(op, space))
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in wanted} for r in done], schema=layout)

    schema = StructType([*ops.select("uuid", "pointer").schema.fields, *outcome.fields])
    first = state.withColumn("is_state", F.lit(True))
    rows = first.unionByName(ops.withColumn("is_state", F.lit(False)), allowMissingColumns=True)
    order: list[Column] = [F.col("pointer"), F.col("is_state").desc(), F.col("index")]
    return rows.repartition("pointer").sortWithinPartitions(*order).mapInArrow(fold, schema)
