import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WEIRD = [None, "", " \t\n", "word", "The same text twice over here now.", "The same text twice over here now.", "a" * 30_000, "\x00\x1c　é😀 <|endoftext|>\r\n\n  x", "x " * 5000]


@pytest.fixture(scope="session")
def weird(tmp_path_factory):
    """A folder with a small ``documents`` table of odd rows, repeated ones among them,
    and more columns than the operators know."""
    root = tmp_path_factory.mktemp("weird")
    ids = [None, *range(1, len(WEIRD))]
    ids[-1] = ids[-2]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": WEIRD, "lang": [None] * len(WEIRD), "source": ["s", None, "s", "t", "t", "t", "s", "s", None], "n_chars": pa.array([len(t or "") for t in WEIRD], pa.int64()), "size": list(range(len(WEIRD))), "spans": ["x"] * len(WEIRD)}), root / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([1, 2, None], pa.int64()), "quality": pa.array([1, 0, 1], pa.int32()), "toxic": pa.array([0, 1, None], pa.int32())}), root / "labels.parquet")
    pq.write_table(pa.table({"page_id": pa.array([1, None, 3, 3], pa.int64()), "url": ["HTTP://A.COM/x?y", None, "no scheme", "http://b.net/es/1"], "html": [None] * 4}), root / "pages.parquet")
    vec = [[1.0, 0.0], [1.0, 0.01], None, [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [1.0, 0.0], [], [1.0]]
    pq.write_table(pa.table({"vec_id": pa.array([1, 2, 3, 4, 5, 6, 7, 8, 9], pa.int64()), "embedding": pa.array(vec, pa.list_(pa.float32())), "label": pa.array([0, 0, 0, 0, 0, 0, 0, None, 0], pa.int32())}), root / "embeddings.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty(tmp_path_factory, weird):
    root = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "pages", "embeddings"):
        pq.write_table(pq.read_table(f"{weird}/{name}.parquet").slice(0, 0), root / f"{name}.parquet")
    return str(root)
