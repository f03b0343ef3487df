"""Scratch data belongs to a job."""

import os

from dqengine.session import materialize, scratch_job, shared_dir


def test_a_job_leaves_nothing_behind(spark):
    folder = shared_dir(spark).removeprefix("file://") + "/dqengine"
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    with scratch_job(spark):
        assert materialize(spark.range(5)).count() == 5
        assert set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) == before
