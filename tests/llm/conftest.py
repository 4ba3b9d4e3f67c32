import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMAS = {
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())],
    "labels": [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())],
    "benchmark": [("item_id", pa.int64()), ("text", pa.string())],
    "conversations": [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())],
    "pages": [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())],
    "embeddings": [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())],
}


@pytest.fixture
def tables(tmp_path):
    """Writes tables (rows as tuples of the leading columns; further columns null) and returns their folder. Every table also gets
    columns whose names operators use for their own."""

    def make(**rows):
        for name, schema in SCHEMAS.items():
            given = rows.get(name, [])
            columns = {c: pa.array([r[k] if k < len(r) else None for r in given], kind) for k, (c, kind) in enumerate(schema)}
            for clash in ("score", "n", "kept", "lang_pred", "rank", "key", "node", "piece", "host", "items", "spans", "block"):
                columns[clash] = pa.array(["x"] * len(given), pa.string())
            pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return make


@pytest.fixture
def frame():
    def collect(df) -> pd.DataFrame:
        return df.toPandas()

    return collect
