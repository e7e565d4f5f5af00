"""Where intermediate tables go."""

from rillwater import session
from rillwater.plans import keep


def test_a_given_folder_counts_before_the_setting(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    try:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
        assert str(tmp_path) in session.shared_folder(spark)
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)


def test_the_folder_of_the_setting_is_recognised():
    assert session._plain("file:/a/b/uuid").startswith(session._plain("file:///a/b"))
    assert not session._plain("file:/a/bc").startswith(session._plain("file:///a/b"))


def test_stored_tables_are_removed(spark):
    kept = keep.store(spark.range(3), "gone")
    path = keep._stored[-1][1].removeprefix("file:")
    import os
    assert kept.count() == 3 and os.path.isdir(path)
    keep.remove_stored()
    assert not os.path.isdir(path)
