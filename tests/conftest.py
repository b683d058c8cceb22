import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tableprep.session import get_session
    ckpt = tempfile.mkdtemp(prefix="tableprep-test-ckpt-", dir="/tmp")
    s = get_session(master="local[*]", shuffle_partitions=8, extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


# Salary demo rows (index, YearsExperience, Salary) typed in as literals.
SALARY = [
    (0, 1.2, 39344.0), (1, 1.4, 46206.0), (2, 1.6, 37732.0), (3, 2.1, 43526.0), (4, 2.3, 39892.0),
    (5, 3.0, 56643.0), (6, 3.1, 60151.0), (7, 3.3, 54446.0), (8, 3.3, 64446.0), (9, 3.8, 57190.0),
    (10, 4.0, 63219.0), (11, 4.1, 55795.0), (12, 4.1, 56958.0), (13, 4.2, 57082.0), (14, 4.6, 61112.0),
    (15, 5.0, 67939.0), (16, 5.2, 66030.0), (17, 5.4, 83089.0), (18, 6.0, 81364.0), (19, 6.1, 93941.0),
    (20, 6.9, 91739.0), (21, 7.2, 98274.0), (22, 8.0, 101303.0), (23, 8.3, 113813.0), (24, 8.8, 109432.0),
    (25, 9.1, 105583.0), (26, 9.6, 116970.0), (27, 9.7, 112636.0), (28, 10.4, 122392.0), (29, 10.6, 121873.0),
]


@pytest.fixture(scope="session")
def salary(spark):
    return spark.createDataFrame(SALARY, "idx long, YearsExperience double, Salary double")
