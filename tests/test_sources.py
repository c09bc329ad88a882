"""Readers, writers, catalog and warehouse options."""

import datetime as dt
import gzip
import os
import uuid
from decimal import Decimal

import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from ledgerlens.bank import Bank
from ledgerlens.operators import cleaning
from ledgerlens.schema import TABLES, struct_for
from ledgerlens.sources import catalog, files, local, members, scratch, warehouse
from tests.conftest import rows


def test_scratch_follows_the_session(spark):
    folder = scratch.shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") == folder
    assert scratch.new_folder(spark, "x") != scratch.new_folder(spark, "x")


@pytest.mark.parametrize("folder", ["file:/w", "/w", None])
def test_scratch_refuses_a_folder_of_one_machine_on_a_cluster(folder):
    from types import SimpleNamespace

    conf = {"spark.sql.warehouse.dir": folder}
    context = SimpleNamespace(master="spark://host:7077", applicationId="a")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(session)
    conf["spark.checkpoint.dir"] = "file:/shared/"
    assert scratch.shared_folder(session) == "file:/shared"


def test_modules_reach_workers_as_an_archive(spark):
    import zipfile

    from ledgerlens.sources import ship

    ship.ship(spark)
    before = spark.sparkContext.listFiles
    ship.ship(spark)
    assert spark.sparkContext.listFiles == before
    assert sum(f.endswith("ledgerlens.zip") for f in before) == 1
    names = zipfile.ZipFile(SparkFiles.get("ledgerlens.zip")).namelist()
    assert "ledgerlens/sources/members.py" in names and "ledgerlens/__init__.py" in names


def test_written_frames_read_back(spark):
    df = spark.range(10)
    again = scratch.written(df, "test")
    assert rows(again) == rows(df)
    assert again.dtypes == df.dtypes


def test_csv_with_messy_header_and_bad_dates(spark, tmp_path):
    text = (
        " branch_name , Opened_Date,BRANCH_ID\n"
        "North,2001-02-03,1\nSouth,garbage,2\n,,3\n"
    )
    (tmp_path / "plain.csv").write_text(text)
    with gzip.open(tmp_path / "zipped.csv.gz", "wt") as f:
        f.write(text)
    expected = [("North", dt.datetime(2001, 2, 3), 1), ("South", None, 2), (None, None, 3)]
    for name in ("plain.csv", "zipped.csv.gz"):
        df = files.read_csv(spark, str(tmp_path / name), "branches")
        assert [k for _, k in df.dtypes] == ["string", "timestamp", "bigint"]
        assert rows(df) == sorted(expected, key=repr)


def test_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text(
        'BRANCH_ID,BRANCH_NAME,OPENED_DATE\n1,"The ""Old"" Mill, North",2001-02-03\n2,"two\nlines",\n'
    )
    df = files.read_csv(spark, str(tmp_path / "q.csv"), "branches", multiline=True)
    assert rows(df, "BRANCH_ID", "BRANCH_NAME") == [(1, 'The "Old" Mill, North'), (2, "two\nlines")]


def test_numbers_as_floats_write_them(spark, tmp_path):
    (tmp_path / "loan.csv").write_text(
        "LOAN_ID,CUSTOMER_ID,LOAN_AMOUNT,INTEREST_RATE\n1,12.0,0.30000000000000004,8.375\n"
        "2.0,33.0,33.333333333333336,7\n2.0,,1e-05,-2.675000000000000045\n9007199254740993,1e+16,x,7\n4,12.5,1.005,nan\n"
    )
    df = files.read_csv(spark, str(tmp_path / "loan.csv"), "loan")
    read = [tuple(None if x is None else float(x) if i > 1 else x for i, x in enumerate(r)) for r in df.collect()]
    assert read == [
        (1, 12, 0.3, 8.375), (2, 33, 33.33333333, 7.0), (2, None, 0.00001, -2.675), (9007199254740993, 10**16, None, 7.0), (4, None, 1.005, None)
    ]


def test_conversion_keeps_every_field_as_it_is(spark, tmp_path):
    (tmp_path / "loan.csv").write_text("LOAN_ID,INTEREST_RATE,START_DATE\n1,8.375,15-Jan-2020 10:30\n2,x,soon\n")
    files.convert_to_parquet(spark, {"loan": str(tmp_path / "loan.csv")}, str(tmp_path / "out"))
    path = str(tmp_path / "out" / "loan.parquet")
    assert rows(spark.read.parquet(path)) == [("1", "8.375", "15-Jan-2020 10:30"), ("2", "x", "soon")]
    typed = files.read_exported_parquet(spark, path, "loan")
    assert [float(r[0]) if r[0] else None for r in typed.select("INTEREST_RATE").collect()] == [8.375, None]


def test_registry_asks_only_for_the_tables_of_the_folder(spark, tmp_path):
    write_all(spark, tmp_path / "x.parquet" / "bank", skip=("loan",))
    spark.range(1).write.parquet(str(tmp_path / "x.parquet" / "bank" / "backup" / "loan.parquet"))
    report = files.registry_report(spark, str(tmp_path / "x.parquet" / "bank")).collect()
    assert [r.table_name for r in report if not r.present] == ["loan"]


def test_gzip_rows_are_spread(spark, tmp_path):
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("BRANCH_ID\n" + "\n".join(map(str, range(1000))))
    df = files.read_csv(spark, str(tmp_path / "b.csv.gz"), "branches", partitions=5)
    assert df.rdd.getNumPartitions() == 5


@pytest.mark.parametrize("codec", ["snappy", "zstd"])
def test_parquet_codec_shows_in_the_file_names(spark, tmp_path, codec):
    files.write_parquet(spark.range(5), str(tmp_path / "t.parquet"), codec)
    parts = [f for f in os.listdir(tmp_path / "t.parquet") if f.endswith(".parquet")]
    assert parts and all(codec if codec == "snappy" else "zstd" in f for f in parts)
    assert files.read_parquet(spark, str(tmp_path / "t.parquet")).count() == 5


def test_codec_depends_on_the_table():
    assert files.codec_for("cards") == "snappy"
    assert files.codec_for("card_transaction") == "zstd"


def write_all(spark, folder, skip=()):
    for table in TABLES:
        if table not in skip:
            df = spark.createDataFrame([], struct_for(table))
            df.write.parquet(f"{folder}/{table}.parquet")


def test_missing_table_is_reported(spark, tmp_path):
    write_all(spark, tmp_path, skip=("loan", "cards"))
    report = {r.table_name: r.present for r in files.registry_report(spark, str(tmp_path)).collect()}
    assert [t for t in TABLES if not report[t]] == ["cards", "loan"]
    with pytest.raises(FileNotFoundError, match="cards, loan"):
        Bank.from_parquet(spark, str(tmp_path))


def test_registry_does_not_confuse_similar_names(spark, tmp_path):
    write_all(spark, tmp_path, skip=("loan",))
    files_found = {r.table_name for r in files.registry_report(spark, str(tmp_path))
                   .filter("present").collect()}
    assert "loan_payment" in files_found and "loan" not in files_found


def test_bank_from_parquet_and_catalog(spark, tmp_path):
    write_all(spark, tmp_path)
    bank = Bank.from_parquet(spark, str(tmp_path))
    assert len(bank) == len(TABLES) and bank["cards"].columns == struct_for("cards").names
    with pytest.raises(KeyError):
        bank["unknown"]
    name = f"bank_{uuid.uuid4().hex}"
    catalog.create_database(spark, name, str(tmp_path / "db"))
    catalog.create_database(spark, name)
    assert catalog.show_database(spark, name).count() == 1
    status = catalog.ingest_all(spark, {t: (lambda t=t: bank[t]) for t in TABLES}, name)
    assert {r.status for r in status.collect()} == {"ok"}
    assert Bank.from_catalog(spark, name)["loan"].schema == struct_for("loan")


def test_one_failing_table_does_not_stop_the_others(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("not parquet")
    name = f"ingest_{uuid.uuid4().hex}"
    catalog.create_database(spark, name, str(tmp_path / "db"))
    status = catalog.ingest_all(
        spark,
        {
            "good": lambda: spark.range(3),
            "corrupt": lambda: spark.read.schema("id bigint").parquet(str(tmp_path / "bad.parquet")),
            "absent": lambda: spark.read.parquet(str(tmp_path / "absent.parquet")),
            "also_good": lambda: spark.range(4),
        },
        name,
    )
    got = {r.table_name: (r.status, r.n_rows) for r in status.collect()}
    assert got == {
        "good": ("ok", 3), "corrupt": ("failed", None), "absent": ("failed", None),
        "also_good": ("ok", 4),
    }


def test_tables_are_overwritten(spark, tmp_path):
    name = f"sink_{uuid.uuid4().hex}"
    catalog.create_database(spark, name, str(tmp_path / "db"))
    catalog.save_table(spark.range(9), f"{name}.t")
    catalog.save_table(spark.range(2), f"{name}.t")
    assert catalog.read_table(spark, f"{name}.t").count() == 2


def test_database_names_are_checked(spark):
    with pytest.raises(ValueError, match="identifier"):
        catalog.create_database(spark, "x; drop")


def test_conversion_report_flags_large_files(spark, tmp_path):
    files.write_csv(spark.range(1000).withColumnRenamed("id", "BRANCH_ID"), str(tmp_path / "b.csv"))
    source = {"branches": str(tmp_path / "b.csv")}
    report = files.convert_to_parquet(spark, source, str(tmp_path / "out")).first()
    assert (report.table_name, report.n_rows, report.status) == ("branches", 1000, "OK")
    assert report.source_mb > 0 and report.parquet_mb > 0
    strict = files.convert_to_parquet(spark, source, str(tmp_path / "out2"), large_mb=0).first()
    assert strict.status == "still large"


ENV = {
    warehouse.ENV_URL: "jdbc:example://host/bank",
    warehouse.ENV_USER: "reader",
    warehouse.ENV_PASSWORD: "secret",
}


def test_warehouse_options():
    source = warehouse.Warehouse.from_env(ENV)
    assert source.options("LOAN")["dbtable"] == "LOAN"
    assert "partitionColumn" not in source.options("LOAN")
    split = source.options("LOAN", warehouse.KeyRange(1, 900, 8))
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"]) == (
        "LOAN_ID", "1", "900",
    )
    assert split["numPartitions"] == "8"
    assert source.bounds_query("LOAN") == "SELECT MIN(LOAN_ID) AS low, MAX(LOAN_ID) AS high FROM LOAN"
    assert "secret" not in repr(source)


@pytest.mark.parametrize(
    "keys",
    [
        [*range(1, 1_001), *range(10**9, 10**9 + 50), None, None],
        [7] * 900 + list(range(100)),
        [f"it's {i % 700:04d}" for i in range(1_000)] + [None],
        [Decimal("0.10"), Decimal("1E+3"), Decimal("-2.5")] * 40,
        [None, None],
        [],
    ],
    ids=["gaps", "hot key", "texts", "decimals", "no keys", "empty"],
)
def test_warehouse_ranges_hold_every_row_once(keys):
    import duckdb

    source, parts = warehouse.Warehouse.from_env(ENV), 8
    db = duckdb.connect()
    kind = {int: "bigint", str: "varchar", Decimal: "decimal(18,2)"}[type(keys[0]) if keys and keys[0] is not None else int]
    db.execute(f"create table loan (LOAN_ID {kind})")
    if keys:
        db.executemany("insert into loan values (?)", [(k,) for k in keys])
    lows = [r[0] for r in db.execute(source.quantiles_query("loan", "LOAN_ID", parts)).fetchall()]
    wanted = warehouse.predicates("LOAN_ID", lows)
    counts = [db.execute(f"select count(*) from loan where {p}").fetchone()[0] for p in wanted]
    once = " + ".join(f"case when {p} then 1 else 0 end" for p in wanted)
    assert db.execute(f"select count(*) from loan where {once} <> 1").fetchone()[0] == 0
    assert sum(counts) == len(keys) and len(wanted) <= parts + 1
    hottest = max((keys.count(k) for k in set(keys)), default=0)
    assert max(counts) <= len(keys) // parts + 1 + hottest


def test_warehouse_refuses_keys_without_an_order_in_sql():
    with pytest.raises(TypeError, match="float"):
        warehouse.predicates("K", [1.5, 2.5])


def test_warehouse_needs_credentials():
    with pytest.raises(KeyError, match=warehouse.ENV_PASSWORD):
        warehouse.Warehouse.from_env({k: v for k, v in ENV.items() if k != warehouse.ENV_PASSWORD})


def test_local_rows(spark):
    assert rows(local.from_local(spark, [("a", 1)], "t string, n bigint")) == [("a", 1)]


def test_row_counts(spark):
    frames = {"a": spark.range(3), "b": spark.range(0)}
    assert rows(catalog.row_counts(frames)) == [("a", 3), ("b", 0)]
    assert catalog.total_rows(frames).first().total_rows == 3


def test_amounts_of_any_length_are_read(spark):
    texts = ["0.123456789", "1e-9", "12.3456789012", "0.30000000000000004", "1.5E3", "-7", " 2.50 ", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "LOAN_AMOUNT string")
    found = [r[0] for r in cleaning.type_columns(df, "loan").collect()]
    want = ["0.12345679", "0", "12.34567890", "0.30000000", "1500", "-7", "2.5", None, None, None]
    assert found == [None if w is None else Decimal(w) for w in want]


@pytest.mark.parametrize("gzip", [False, True])
def test_csv_round_trip(spark, tmp_path, gzip):
    """Quotes, commas, line breaks, blanks, empty text and null come back as they were."""
    rows = [
        (1, 'say "hi", x'), (2, "a,b"), (3, "two\nlines"), (4, ""), (5, None), (6, '"'), (7, '""'),
        (8, " blanks  "), (9, "back\\slash\\"), (10, "tail,\"q\" "), (11, "\r\nx"), (12, "é日本"),
    ]
    df = spark.createDataFrame(rows, "BRANCH_ID long, BRANCH_NAME string")
    path = f"{tmp_path}/branches.csv" + (".gz" if gzip else "")
    files.write_csv(df.coalesce(1), path, gzip)
    read = files.read_csv(spark, path, "branches", multiline=True)
    assert sorted(tuple(r) for r in read.collect()) == rows
    plain = [r for r in rows if r[1] is None or not set("\r\n") & set(r[1])]
    files.write_csv(spark.createDataFrame(plain, df.schema).coalesce(2), path, gzip)
    read = files.read_csv(spark, path, "branches")
    assert sorted(tuple(r) for r in read.collect()) == plain


def failing(spark, n=1000):
    """Rows of which the last ones cannot be computed, after others have been written."""
    rows = spark.range(n).repartition(4)
    bad = F.when(F.col("id") == n - 1, F.raise_error(F.lit("half-way")).cast("string")).otherwise("x")
    return rows.select(F.col("id").alias("BRANCH_ID"), bad.alias("BRANCH_NAME"))


def test_a_failed_write_keeps_the_old_files(spark, tmp_path):
    path = f"{tmp_path}/branches.parquet"
    old = spark.createDataFrame([(1, "a")], "BRANCH_ID long, BRANCH_NAME string")
    files.write_parquet(old, path)
    with pytest.raises(Exception, match="half-way"):
        files.write_parquet(failing(spark), path)
    assert rows(spark.read.parquet(path)) == [(1, "a")]
    # A table may be rewritten from itself; the version before stays.
    more = spark.read.parquet(path).unionByName(spark.createDataFrame([(2, "b")], old.schema))
    files.write_parquet(more, path, "zstd")
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b")]
    assert rows(spark.read.parquet(f"{path}.previous")) == [(1, "a")]
    files.write_parquet(old, path)
    assert sorted(os.listdir(tmp_path)) == ["branches.parquet", "branches.parquet.previous"]


def test_a_failed_table_keeps_its_old_rows(spark):
    name = f"ledgerlens_stage_{uuid.uuid4().hex[:8]}"
    catalog.create_database(spark, name)
    old = spark.createDataFrame([(1, "a")], "BRANCH_ID long, BRANCH_NAME string")
    loaders = {"branches": lambda: old, "loan": lambda: old}
    assert {r.status for r in catalog.ingest_all(spark, loaders, name).collect()} == {"ok"}
    loaders = {"branches": lambda: failing(spark), "loan": lambda: old.union(old)}
    status = {r.table_name: (r.n_rows, r.status) for r in catalog.ingest_all(spark, loaders, name).collect()}
    assert status == {"branches": (None, "failed"), "loan": (2, "ok")}
    assert rows(catalog.read_table(spark, f"{name}.branches")) == [(1, "a")]
    assert rows(catalog.read_table(spark, f"{name}.loan__previous")) == [(1, "a")]
    listed = {r.tableName for r in spark.sql(f"SHOW TABLES IN {name}").collect()}
    assert listed == {"branches", "loan", "loan__previous"}
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_bucketed_event_tables_are_grouped_and_joined_without_a_shuffle(spark, sf_dir):
    from ledgerlens import testbed
    from ledgerlens.plans import derived

    given, name = testbed.bank_on(spark, sf_dir), f"ledgerlens_bucket_{uuid.uuid4().hex[:8]}"
    catalog.create_database(spark, name)
    loaders = {t: (lambda t=t: given[t]) for t in TABLES}
    status = catalog.ingest_all(spark, loaders, name, buckets=4).collect()
    assert {r.status for r in status} == {"ok"}
    bank = Bank.from_catalog(spark, name)
    for build in (derived.card_totals, derived.payment_history, derived.pay_stats):
        plan = build(bank)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert rows(build(bank)) == rows(build(given))
    joined = bank["cards"].join(derived.card_totals(bank), "CARD_ID")
    plan = joined.hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning" in p and "card_transaction" in p for p in plan.split("SortMergeJoin"))
    spark.sql(f"DROP DATABASE {name} CASCADE")


def torn_text(line_end="\n", n=4_000):
    """CSV records, a third of them torn, and what their fields are."""
    expected, text = [], f"ID,NOTE{line_end}"
    for i in range(n):
        note = [f'plain {i}', f'two{line_end}lines, "{i}"', "", f'{line_end * (i % 7)}"{i}",{line_end}'][i % 4]
        expected.append((str(i), note))
        text += f'{i},"{note.replace(chr(34), chr(34) * 2)}"{line_end}'
    return expected, text


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_torn_records_are_read_by_many_tasks(spark, tmp_path, line_end):
    expected, text = torn_text(line_end)
    # One field is longer than many blocks and has the lines of other records in it.
    long = line_end.join(f"{i},x" for i in range(9_000))
    expected.append(("long", long))
    text += f'long,"{long}"{line_end}'
    expected += [("last", "a")]
    text += "last,a"
    (tmp_path / "torn.csv").write_bytes(text.encode())
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "4096")
    try:
        df = files.read_text_fields(spark, str(tmp_path / "torn.csv"), multiline=True)
        got = sorted(map(tuple, df.collect()))
        from ledgerlens.sources import torn

        blocks = torn._blocks(torn.block_lines(spark, str(tmp_path / "torn.csv")))
        assert blocks.count() > 20 and blocks.filter("parity = 1").count() > 5
    finally:
        spark.conf.set(size, before)
    assert df.columns == ["ID", "NOTE"] and got == sorted(expected)


def test_torn_files_in_folders_and_gzip(spark, tmp_path):
    expected, text = torn_text(n=50)
    (tmp_path / "many").mkdir()
    for i in range(3):
        (tmp_path / "many" / f"{i}.csv").write_text(text)
    with gzip.open(tmp_path / "many" / "3.csv.gz", "wt") as f:
        f.write(text)
    df = files.read_text_fields(spark, str(tmp_path / "many"), multiline=True)
    assert sorted(map(tuple, df.collect())) == sorted(expected * 4)


def test_torn_edges(spark, tmp_path):
    (tmp_path / "e.csv").write_text('A,B\n\n1,\n,""\n"x\n\ny",\n2\n')
    df = files.read_text_fields(spark, str(tmp_path / "e.csv"), multiline=True)
    assert rows(df) == sorted([("1", None), (None, ""), ("x\n\ny", None), ("2", None)], key=repr)
    (tmp_path / "only.csv").write_text("A,B\n")
    assert files.read_text_fields(spark, str(tmp_path / "only.csv"), multiline=True).count() == 0
    (tmp_path / "open.csv").write_text('A,B\n1,"never\nclosed\n')
    with pytest.raises(Exception, match="a quote is never closed in .*open.csv"):
        files.read_text_fields(spark, str(tmp_path / "open.csv"), multiline=True).collect()


def member_file(path, text, sizes, nested=b""):
    """Gzip members that cut the text wherever their sizes say, records or not."""
    raw, at, members = text.encode(), 0, []
    for i in range(len(sizes) or 1):
        end = at + sizes[i] if i + 1 < len(sizes) else len(raw)
        members.append(gzip.compress(raw[at:end] + (nested if i + 1 == len(sizes) else b"")))
        at = end
    path.write_bytes(b"".join(members))
    return [len(m) for m in members]


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [100, 5_000, 10**9])
def test_gzip_members_are_read_apart(spark, tmp_path, line_end, block):
    text = f"A,B{line_end}" + "".join(f'{i},"v {i * 7919 % 1000}"{line_end}' for i in range(5_000))
    # Members end within a line, at its end, hold nothing, one byte, or no line break at all.
    sizes = [len(text) // 8, 1, 0, 2, len(text) // 8, text.index(f"{line_end}2500,") - len(text) // 4 - 3 + len(line_end), 1, 9]
    path = tmp_path / "m.csv.gz"
    lengths = member_file(path, text + "last,x", sizes)
    index = rows(members.member_index(spark, str(path), block))
    assert [e - s for _, s, e in sorted(index, key=lambda r: r[1])] == lengths
    df = files.read_text_fields(spark, str(path), members=True, block_bytes=block)
    expected = [(str(i), f"v {i * 7919 % 1000}") for i in range(5_000)] + [("last", "x")]
    assert df.columns == ["A", "B"]
    assert sorted(map(tuple, df.collect())) == sorted(expected)


def test_eight_members_make_eight_tasks(spark, tmp_path):
    import random

    chance = random.Random(5)
    text = "A,B\n" + "".join(f"{i},{chance.random()}\n" for i in range(40_000))
    lengths = member_file(tmp_path / "m.csv.gz", text, [len(text) // 8] * 8)
    df = files.read_text_fields(spark, str(tmp_path / "m.csv.gz"), members=True, block_bytes=min(lengths) - 100)
    tasks = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 8 and sum(r["count"] for r in tasks) == 40_000


def test_torn_records_over_gzip_members(spark, tmp_path):
    expected, text = torn_text(n=400)
    (tmp_path / "many").mkdir()
    member_file(tmp_path / "many" / "0.csv.gz", text, [len(text) // 9] * 9)
    member_file(tmp_path / "many" / "1.csv.gz", text, [])
    df = files.read_text_fields(spark, str(tmp_path / "many"), multiline=True, members=True, block_bytes=200)
    assert sorted(map(tuple, df.collect())) == sorted(expected * 2)


def test_gzip_within_gzip_is_content(spark, tmp_path):
    inner = gzip.compress(b"x,y\n" * 50)
    member = gzip.compress(b"A\n" + inner + b"\n", compresslevel=0)
    (tmp_path / "n.csv.gz").write_bytes(member + gzip.compress(b"end\n") + b"\0" * 700)
    for block in (8, 64, 10_000):
        index = rows(members.member_index(spark, str(tmp_path / "n.csv.gz"), block), "start")
        assert index == [(0,), (len(member),)]


def test_damaged_gzip_files_are_reported(spark, tmp_path):
    path = tmp_path / "d.csv.gz"
    member_file(path, "A\n" + "1\n2\n" * 3_000, [4_000] * 4)
    whole = path.read_bytes()
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 0xFF
    for raw in (whole[:-5], bytes(flipped), whole + b"tail", b"A\n1\n"):
        path.write_bytes(raw)
        with pytest.raises(OSError, match="whole gzip members cover"):
            members.member_index(spark, str(path), 64)
    path.write_bytes(b"")
    assert members.read_lines(spark, str(path)).count() == 0
