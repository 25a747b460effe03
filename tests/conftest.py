import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fleetsieve.session import local_session
    session = local_session("8", "tests", "8g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def make_fleet(spark):
    """Fleet from {dataset_id: (task, rows)} with rows of (num, txt, y_str, y_num, batch)."""
    from fleetsieve.fleet import Fleet

    def make(spec, source="s"):
        datasets, samples, features = [], [], []
        for pos, (name, (task, rows)) in enumerate(spec.items()):
            src = source if isinstance(source, str) else source[name]
            datasets.append((name, src, pos, name, task, "general", ""))
            for i, (num, txt, y_str, y_num, batch) in enumerate(rows):
                samples.append((name, i, num, txt, y_str, y_num, batch))
            width = len(rows[0][0]) + len(rows[0][1]) if rows else 0
            features += [(name, j, f"f{j}", rows and j < len(rows[0][0])) for j in range(width)]
        return Fleet(
            spark.createDataFrame(datasets, "dataset_id string, source string, pos int, name string, task_type string, domain string, url string"),
            spark.createDataFrame(features, "dataset_id string, feat_id int, feat string, is_num boolean"),
            spark.createDataFrame(samples, "dataset_id string, row_id bigint, num array<double>, txt array<string>, y_str string, y_num double, batch string"))

    return make
