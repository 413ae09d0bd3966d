"""Ranged sources with a made-up loader, and formats found from values."""

import datetime as dt

import pytest

from sextant.sources import delimited
from sextant.sources.formats import infer_formats, normalised
from sextant.sources.remote import day_ranges, ranged_source

D = dt.date
SCHEMA = "day date, close double, range string"


@pytest.fixture
def source(spark):
    def loader(options, start, end):
        if options.get("fail") == "request" and start >= D(2024, 1, 11):
            raise ConnectionError("refused")
        if options.get("fail") == "answer":
            raise ValueError("no JSON")
        for i in range((end - start).days):
            yield start + dt.timedelta(i), float(options.get("base", 0)) + i, f"{start}/{end}"

    spark.dataSource.register(ranged_source("made", SCHEMA, loader, until=lambda options: D.fromisoformat(options["until"])))
    return lambda: spark.read.format("made")


def test_a_range_of_days_is_a_partition(source):
    df = source().options(start="2024-01-01", end="2024-02-05", days="10", base="100").load()
    got = df.orderBy("day").collect()
    assert [r.day for r in got] == [D(2024, 1, 1) + dt.timedelta(i) for i in range(35)] and got[0].close == 100
    assert df.rdd.getNumPartitions() == 4 and len({r.range for r in got}) == 4
    assert source().options(start="2024-01-01", end="2024-01-01").load().count() == 0
    assert [(x.start, x.end) for x in day_ranges(D(2024, 1, 1), D(2024, 1, 4), 2)] == [(D(2024, 1, 1), D(2024, 1, 3)), (D(2024, 1, 3), D(2024, 1, 4))]


@pytest.mark.parametrize(("options", "said"), [({"fail": "request"}, "2024-01-11 to 2024-01-21: request failed: refused"), ({"fail": "answer"}, "cannot be read: no JSON"), ({"days": "0"}, "days must be"), ({"end": "2023-01-01"}, "start lies after end")])
def test_failures_tell_their_range(source, options, said):
    with pytest.raises(Exception, match=said):
        source().options(**({"start": "2024-01-01", "end": "2024-01-21", "days": "10"} | options)).load().collect()


def test_a_stream_goes_on_where_it_ended(spark, source, tmp_path):
    def run(until):
        stream = spark.readStream.format("made").options(start="2024-01-01", until=until, days="7").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.day for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run("2024-01-20") == [D(2024, 1, 1) + dt.timedelta(i) for i in range(19)]
    assert run("2024-02-01") == [D(2024, 1, 1) + dt.timedelta(i) for i in range(31)]


def test_formats_are_decided_by_evidence(spark):
    days = [D(2024, 1, 3), D(2024, 2, 4), D(2024, 5, 25)]
    rows = [
        (f"{d:%m/%d/%Y}", f"{d:%d/%m/%Y}", f"{d.day}.{d.month}.{d.year}", f"{d:%d %b %Y}", f"{d:%Y%m%d}", f"{d.month}/{d.day}/2024" if d.day < 9 else None, n, g, p, "x" + n)
        for d, n, g, p in zip(days, ["1,234.50", "-2", "1,000,000"], ["1.234,5", "2,25", ""], ["$3.5", "(4)", "50%"], strict=True)
    ]
    names = ["us", "eu", "dotted", "named", "packed", "unclear", "grouped", "comma", "signs", "text"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = infer_formats(df)
    assert {c: x.format for c, x in got.items()} == {
        "us": "M/d/yyyy", "eu": "d/M/yyyy", "dotted": "d.M.yyyy", "named": "d MMM yyyy", "packed": "yyyyMMdd", "unclear": "M/d/yyyy", "grouped": "1,234.5", "comma": "1.234,5", "signs": "1234.5", "text": None,
    }
    assert [c for c, x in got.items() if not x.decided] == ["unclear"] and not any(x.conflicts for x in got.values())
    plain = [tuple(r) for r in normalised(df).collect()]
    assert plain[2][:5] == ("2024-05-25",) * 5 and [r[6] for r in plain] == ["1234.5", "-2.0", "1000000.0"] and [r[7] for r in plain] == ["1234.5", "2.25", None]
    assert [r[8] for r in plain] == ["3.5", "-4.0", "50.0"] and plain[0][9] == "x1,234.50"
    with pytest.raises(ValueError, match="unclear"):
        normalised(df, decided=True)


def test_conflicts_are_counted_and_empty_tables_are_text(spark):
    df = spark.createDataFrame([("13/1/2024",), ("14/1/2024",), ("1/15/2024",), ("2/2/2024",), (" ",), (None,)], "d string")
    got = infer_formats(df)["d"]
    assert (got.format, got.known, got.parsed, got.conflicts, got.decided) == ("d/M/yyyy", 4, 3, 1, True)
    assert infer_formats(df.limit(0))["d"].kind == "text" and normalised(df.limit(0)).count() == 0


def test_parsers_take_tables_of_any_format(spark):
    rows = spark.createDataFrame([("25.12.2024", "1.234,5"), ("26.12.2024", "1.300,25")], "date string, close string")
    got = {r.date: r.close for r in delimited.parse_prices(normalised(rows)).collect()}
    assert got == {D(2024, 12, 25): 1234.5, D(2024, 12, 26): 1300.25}


def test_chain_of_sources(spark, tmp_path):
    from sextant.schema import DataValidationError
    from sextant.sources.chain import load_series

    asked = []

    def download(start, end):
        asked.append((start, end))
        return spark.createDataFrame([(dt.datetime(2024, 1, 2), 5.0)], "ts timestamp, close_X double")

    load = lambda **more: load_series(spark, str(tmp_path), D(2024, 3, 1), **more)
    with pytest.raises(DataValidationError, match="not there"):
        load()
    (tmp_path / "scores.csv").write_text("date,value\n2024-01-02,40\n2024-01-03,50\n")
    with pytest.raises(DataValidationError, match="scores.csv \\+ download: not there"):
        load()
    daily, market, label = load(download=download)
    assert label == "scores.csv + download" and daily.count() == 2 and market.first().open == 5.0 and asked == [(D(2024, 1, 2) - dt.timedelta(450), D(2024, 3, 2))]
    (tmp_path / "combined.csv").write_text("score_date_utc,score_value,price_date,price_open,price_high,price_low,price_close\n2024-01-02,40,2024-01-02,1,2,0.5,1.5\n")
    (tmp_path / "prices.csv").write_text("date,close\n2024-01-02,?\n")
    assert load(download=download)[2] == "combined.csv"
    (tmp_path / "prices.csv").write_text("date,close\n2024-01-02,7\n")
    assert load()[2] == "scores.csv + prices.csv"
    (tmp_path / "combined.csv").write_text("x,y\n")
    (tmp_path / "prices.csv").write_text("date,close\n")
    with pytest.raises(DataValidationError, match="missing columns"):
        load()
    with pytest.raises(ValueError, match="context"):
        load(context=300)
