"""Pages of the catalogue listing."""

from datetime import datetime

from folioscope.operators import catalog


def test_pages_in_a_row_are_the_listing(spark):
    when = [None, None, *(datetime(2024, 1, 1 + i // 3) for i in range(10))]
    docs = spark.createDataFrame([(i, f"f{i}.txt", t, 10) for i, t in enumerate(when)], "doc_id long, filename string, uploaded_at timestamp_ntz, n_bytes int")
    tags = spark.createDataFrame([(3, "b"), (3, "a"), (0, "x")], "doc_id long, tag string")
    status = spark.createDataFrame([(i, True, False, True) for i in range(12)], "doc_id long, has_chunks boolean, has_vectors boolean, has_metadata boolean")
    whole = [tuple(r) for r in catalog.catalog_listing(docs, tags, status).collect()]
    for size in (1, 4, 5, 50):
        pages, after = [], None
        while page := [tuple(r) for r in catalog.catalog_page(docs, tags, status, size, after).collect()]:
            pages += page
            after = (page[-1][2], page[-1][0])
            assert len(page) <= size
        assert pages == whole
