import pytest


@pytest.fixture(scope="session")
def spark(spark):
    from strandline.llm.ship import ship

    ship(spark)
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, slot string, n string, k string, root string, score string, copies string, _id string"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents with extra columns whose names the operators use inside."""

    def make(rows, lang="en", source="s"):
        full = [(i, t, (r[0] if r else lang), (r[1] if len(r) > 1 else source), len(t) if t is not None else None, *["x"] * 8) for i, t, *r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make
