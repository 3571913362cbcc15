"""New ratings that meet the ids of old ones."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folio.plans import dialogues


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_new_ratings_meet_old_ids(spark, tmp_path, parts):
    old = {i: -1 if i % 4 == 3 else i % 2 for i in [*range(1, 400), *range(100_001, 100_400, 2), 200_003, 200_004]}
    pq.write_table(pa.table({"doc_id": list(old), "quality": pa.array([i % 2 for i in old], pa.int32()), "toxic": pa.array([int(i % 4 == 3) for i in old], pa.int32())}), tmp_path / "labels.parquet")
    # of updates with one number the message's own comes first, as in the SQL's union
    wanted = {i + 100_000: (1, "new") for i in old}
    wanted |= {i: (0 if i % 5 == 0 else -s, f"note {i}" if i % 3 else "new" if i - 100_000 in old else None) for i, s in old.items()}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.message_id: (r.score, r.comment) for r in dialogues.QUERIES["feedback_upsert"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == wanted
