from unitlife import session


class Context:
    def __init__(self, master):
        self.master, self.applicationId = master, f"app-{master}"


class Session:
    def __init__(self, master, **conf):
        self.sparkContext, self.conf = Context(master), conf


def test_the_named_folder_is_used():
    assert session.shared_folder(Session("spark://x", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"


def test_else_a_folder_of_the_warehouse():
    plain = Session("spark://x", **{"spark.sql.warehouse.dir": "hdfs://a/warehouse"})
    assert session.shared_folder(plain) == "hdfs://a/warehouse/_stages"


def test_folder_from_a_real_session(spark):
    assert session.shared_folder(spark)
    session.use_checkpoints(spark)
    assert spark.sparkContext.getCheckpointDir()
