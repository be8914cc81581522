"""Stateful sequence decoder as a table function."""

from __future__ import annotations

from pyspark.sql.functions import udtf


def greedy_decoder(blank: int):
    """Table function over TABLE(seq, label) PARTITION BY seq ORDER BY position: one row (seq, labels)."""

    @udtf(returnType="seq: bigint, labels: array<bigint>")
    class Decoder:
        def __init__(self):
            self.seq, self.kept, self.previous = None, [], blank

        def eval(self, row):
            self.seq, label = row["seq"], row["label"]
            if label not in (blank, self.previous):
                self.kept.append(label)
            self.previous = label

        def terminate(self):
            if self.seq is not None and self.kept:
                yield self.seq, self.kept

    return Decoder
