from parasift.llm.exact_dedup import DigestIndex, classify, keep_rows

ROWS = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (None, "same text"), (6, "é")]


def test_groups_ties_and_nulls(make_docs):
    got = {}
    for r in classify(make_docs(ROWS, extra=True)).collect():
        got.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    assert got[1] == [(2, 3, False)] and got[2] == [(2, 3, True)] and got[None] == [(2, 3, False)]
    assert got[3] == [(4, 2, False)] and got[4] == [(4, 2, True)]
    assert got[5] == [(5, 1, True)]  # only A-Z fold
    assert sorted(got[6]) == [(6, 2, False), (6, 2, True)]  # equal rows: exactly one stays
    assert got[7] == [(7, 1, True)]


def test_keep_rows_returns_all_columns(make_docs):
    docs = make_docs(ROWS, extra=True)
    kept = keep_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 7]


def test_empty_table(make_docs):
    assert classify(make_docs([])).count() == 0 and keep_rows(make_docs([])).count() == 0


def test_index_persists_over_batches(spark, make_docs):
    index = DigestIndex(spark, buckets=4)
    assert index.add(make_docs([(1, "a"), (2, "b"), (3, "B")]))
    assert not index.add(make_docs([(9, "A"), (10, "c")]))
    again = DigestIndex(spark, path=index.path, buckets=4)  # the files outlive the table
    assert {(r["keep_id"], r["group_size"]) for r in again.rows().collect()} == {(9, 2), (3, 2), (10, 1)}
    kept = keep_rows(make_docs([(8, "a"), (21, "new")]), index=again)
    assert [r["doc_id"] for r in kept.collect()] == [21]  # 9 stays


def test_largest_id_stays_over_batches(spark, make_docs):
    index = DigestIndex(spark, buckets=4)
    classify(make_docs([(1, "a"), (2, "A")]), index=index).collect()
    rows = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in
            classify(make_docs([(9, "a"), (10, "A"), (4, "b")]), index=index).collect()}
    assert rows == {9: (10, 4, False), 10: (10, 4, True), 4: (4, 1, True)}
    assert sorted(r["doc_id"] for r in keep_rows(make_docs([(11, "a"), (3, "B"), (12, None)]), index=index).collect()) == [11, 12]
    plan = index.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_bucketed_index_is_not_shuffled(spark):
    index = DigestIndex(spark, buckets=8)
    one, two = index.entries().select("digest").hint("merge"), index.entries().select("digest")
    plan = one.join(two, "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
