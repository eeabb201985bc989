"""Folders of tables without rows, and of rows without values."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"


def edge_tables(root):
    out = {}
    for kind in ("empty", "null"):
        out[kind] = str(root / kind)
        os.makedirs(out[kind])
        for f in os.listdir(SF):
            t = pq.read_table(f"{SF}/{f}")
            rows = pa.table({n: pa.nulls(5, t.schema.field(n).type) for n in t.column_names}, schema=t.schema)
            pq.write_table(rows.slice(0, 0) if kind == "empty" else rows, f"{out[kind]}/{f}")
    return out
