from cloakwork.sources import records


def test_map_round_trip(spark, tmp_path):
    path = str(tmp_path / "map.yml")
    empty, options = records.read_map(spark, path)
    assert empty.count() == 0 and options["longest_first"]
    rows = [("brand", 0, "Acme", "Vendor", "brand:0001"), ("other", 0, "x", "y", "other:0002"), ("brand", 1, "Älpen", "V2", "brand:0003")]
    records.write_map(spark.createDataFrame(rows, records.SMAP), path)
    back, _ = records.read_map(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_candidates_round_trip(spark, tmp_path):
    path = str(tmp_path / "c.yml")
    schema = "value string, category string, confidence double, count int"
    records.write_candidates(spark.createDataFrame([("a", "ids", 0.12345, 2), ("b", "", 1.0, 1)], schema), path)
    assert sorted(map(tuple, records.read_candidates(spark, path, schema).collect())) == [("a", "ids", 0.123, 2), ("b", "other", 1.0, 1)]


def test_decisions(spark, tmp_path):
    log = tmp_path / "d.jsonl"
    log.write_text('{"kind": "t0_assign", "rule": "r", "value": "v", "placeholder": "7"}\nbroken\n{"kind": "t0_assign", "rule": "r", "value": "w", "placeholder": "1f"}\n{"kind": "decision", "action": "promote", "value": "v", "placeholder": "p", "category": "ids"}\n')
    known, made = records.decisions(spark, str(log))
    assert {(r.key, r.n) for r in known.collect()} == {("v", 7), ("w", 31)}
    assert [(r.action, r.value) for r in made.collect()] == [("promote", "v")]


def test_migrations_run_in_order():
    @records.migration("test", 1)
    def one(d):
        return {**d, "a": 1}

    @records.migration("test", 3)
    def three(d):
        return {**d, "b": d["a"] + 1}

    assert records.migrate("test", {}, 4) == ({"a": 1, "b": 2, "version": 4}, True)
    assert records.migrate("test", {"version": 4}, 4) == ({"version": 4}, False)


def test_reports_and_targets(spark):
    hits = spark.createDataFrame([("f", "ip", "1.2.3.4", 3, "at 1.2.3.4")], "file_rel string, pattern string, match string, off int, snippet string")
    assert "1 LEAKS" in records.leak_report(hits, 2, ["a.zip"]) and "CLEAN" in records.leak_report(hits.limit(0), 2)
    assert records.RunConfig(("a",), "out", "single").target("d/x.pdf") == "out/x.anonymized.pdf"
    assert records.RunConfig(("a",), "o.pdf", "single").target("x.pdf") == "o.pdf"
    assert records.RunConfig(("a",), "out", "multi").target("d/x.md") == "out/x.md"
    assert records.RunConfig(("a",), "out").target("d/x.md") == "out/d/x.md"
    events = spark.createDataFrame([("f", "0", 5, 1, 5, 1, "a", "b", "ids", "i", "T"), ("f", "0", 1, 1, 1, 1, "a", "b", "ids", "i", "T")], "file_rel string, seg_id string, orig_off int, orig_len int, anon_off int, anon_len int, from string, to string, category string, mapping_id string, tier string")
    row = records.apply_report(events).head()
    assert row.n_events == 2 and row.events.index('"orig_off":1') < row.events.index('"orig_off":5')
