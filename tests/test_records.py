"""Records of CSV files over many splits, against Spark's one-task reader, and their faults."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from trialbraid.schema import INGEST_POS
from trialbraid.sources import files, records


@pytest.fixture
def small_splits(spark):
    """Splits of a few lines."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cell(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.35:
        return "".join(rng.choice("ab ü5/") for _ in range(rng.randrange(1, 9)))
    if kind < 0.5:
        return ""
    inner = "".join(rng.choice(["a", "é", ",", '""', "\n", "\r\n", " ", "x,y", "b"]) for _ in range(rng.randrange(12)))
    if rng.random() < 0.03:
        inner += "long\n" * 120
    return f'"{inner}"'


@pytest.mark.parametrize("seed", range(6))
def test_random_quoted_files_equal_the_multi_line_reader(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    end = rng.choice(["\n", "\r\n"]) if seed != 3 else "\n"
    for f in range(3):
        rows = [["k", "t", "z"]] + [[f"{f}-{i}", cell(rng), cell(rng)] for i in range(rng.randrange(150))]
        text = end.join(",".join(r) for r in rows)
        if rng.random() < 0.7:
            text += end
        (tmp_path / f"f {f}.csv").write_bytes(text.encode())
    plain = (
        spark.read.schema("k string, t string, z string").option("header", True)
        .option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path))
    )
    got = files.scan_csv(spark, str(tmp_path))
    # That reader turns line ends inside of cells into \n where the file ends its lines by \r\n.
    key = lambda r: r[0]
    norm = lambda v: v if v is None else v.replace("\r\n", "\n")
    wanted = sorted([tuple(map(norm, r)) for r in plain.collect()], key=key)
    found = got.orderBy(INGEST_POS).select("k", "t", "z").collect()
    assert sorted([tuple(map(norm, r)) for r in found], key=key) == wanted
    # In the order of the files.
    place = [(int(k.split("-")[0]), int(k.split("-")[1])) for k, _, _ in found]
    assert place == sorted(place)
    assert files.rejected_csv(spark, str(tmp_path)).count() == 0


def test_a_file_with_line_breaks_is_read_by_many_tasks(spark, tmp_path, small_splits):
    path = tmp_path / "one.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x\ny{i}"\n' for i in range(200)))
    rows = files.scan_csv(spark, str(path))
    parts = rows.selectExpr("b", "spark_partition_id() AS p").collect()
    assert {r.b for r in parts} == {f"x\ny{i}" for i in range(200)}
    assert len({r.p for r in parts}) > 5


def test_all_faults_are_listed_whole_and_counted(spark, tmp_path):
    good = ["1,a,b", '2,"c, ""d"" \n e",f', "3,,", '4,x 5" pipe,y']
    bad = {
        "5,too": files.TOO_FEW,
        '6,"line\nbreak"': files.TOO_FEW,
        "7,a,b,more,more": files.TOO_MANY,
        '8,"quoted" text,z': records.STRAY,
    }
    (tmp_path / "f.csv").write_text("\n".join(["k,t,z", *good[:2], *bad, *good[2:], '9,"open,b', "10,a,b", ""]))
    rejected = files.rejected_csv(spark, str(tmp_path))
    got = {r.text: r.reason for r in rejected.collect()}
    assert got == bad | {'9,"open,b': records.UNCLOSED, "10,a,b": records.UNCLOSED}
    kept = files.scan_csv(spark, str(tmp_path), faults="reject").orderBy(INGEST_POS).collect()
    assert [(r.k, r.t, r.z) for r in kept] == [
        ("1", "a", "b"), ("2", 'c, "d" \n e', "f"), ("3", None, None), ("4", 'x 5" pipe', "y"),
    ]
    assert len(kept) + rejected.count() == len(good) + len(bad) + 2
    # Without joined lines, an open quote is a fault of its line alone.
    one = {r.text: r.reason for r in files.rejected_csv(spark, str(tmp_path), multi_line=False).collect()}
    assert one['9,"open,b'] == records.UNCLOSED and "10,a,b" not in one
    assert one['2,"c, ""d"" '] == records.UNCLOSED and one[' e",f'] == files.TOO_FEW


@pytest.mark.parametrize("line", ["1,a", "1,a,b,c", '1,"a"b,c', '1,"a,b'])
@pytest.mark.parametrize("multi_line", [True, False])
def test_a_fault_is_an_error_by_default(spark, tmp_path, line, multi_line):
    (tmp_path / "f.csv").write_text(f"k,t,z\n0,x,y\n{line}\n2,x,y\n")
    with pytest.raises(Exception, match="fields|quote"):
        files.scan_csv(spark, str(tmp_path), multi_line).select("k").collect()


def test_an_unclosed_quote_in_many_splits(spark, tmp_path, small_splits):
    lines = [f'{i},"a\nb {i}",z' for i in range(60)]
    (tmp_path / "f.csv").write_text("\n".join(["k,t,z", *lines, 'x,"open,z', *[f"{i},b,c" for i in range(100)]]))
    assert files.scan_csv(spark, str(tmp_path), faults="reject").count() == 60
    rejected = files.rejected_csv(spark, str(tmp_path)).collect()
    assert len(rejected) == 101 and {r.reason for r in rejected} == {records.UNCLOSED}


def test_states_of_lines_equal_a_character_walk():
    rng = random.Random(1)

    def walk(inside: bool, line: str) -> bool:
        i, begin = 0, not inside
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    inside = False
            elif begin and c == '"':
                inside = True
            begin = c == "," and not inside
            i += 1
        return inside

    lines = ["".join(rng.choice('",",a') for _ in range(rng.randrange(12))) for _ in range(4000)]
    opens, stays = records._changes(pa.array(lines))
    assert opens.tolist() == [walk(False, x) for x in lines]
    assert stays.tolist() == [walk(True, x) for x in lines]
    for start in (False, True):
        states, now = records.line_states(start, opens, stays), start
        for i, x in enumerate(lines):
            assert states[i] == now
            now = walk(now, x)
        assert states[-1] == now


def test_headers_are_read_without_the_rest(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("a,b\n" + "1,2\n" * 500)
    (tmp_path / "b.csv").write_text("\ufeffb,a\r\n" + "3,4\r\n" * 2)
    heads = records.first_lines(spark, str(tmp_path))
    assert sorted(h.lstrip("\ufeff") for h in heads.values()) == ["a,b", "b,a\r"]
    rows = files.scan_csv(spark, str(tmp_path), multi_line=False)
    assert rows.where("a = '4' AND b = '3'").count() == 2 and rows.count() == 502
    assert rows.where("a = '1' AND b = '2'").count() == 500
    (tmp_path / "c.csv").write_text('"x\ny",z\n1,2\n')
    with pytest.raises(ValueError, match="spans lines"):
        files.scan_csv(spark, str(tmp_path))
