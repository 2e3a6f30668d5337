"""Splittable CSV: the same cells as the reader that takes a file in one task."""

import random

from pyspark.sql import functions as F

from shelfmark.sources.csv_exports import read_csv_exports, read_csv_group
from shelfmark.sources.csv_records import block_states, csv_blocks, csv_lines, csv_records, ends_inside


def _cell(rng):
    text = "".join(rng.choice(["a", "b c", "é", ",", '""', "\n", "x\ny", "longer words here", " "]) for _ in range(rng.randint(0, 9)))
    plain = text.replace(",", ";").replace("\n", " ").replace('""', "q")
    return rng.choice([f'"{text}"', plain, plain + ' 5" disk', f'"{text}" tail', "", '""'])


def _file(rng, rows, end):
    head = "title,abstract,contributors,publicationDate,doi"
    lines = [",".join(_cell(rng) for _ in range(rng.choice([5, 5, 5, 3, 7]))) for _ in range(rows)]
    lines[rows // 2] = ""
    return (head + "\n" + "\n".join(lines)).replace("\n", end)


def _both(spark, path, names, utf8=True):
    whole = read_csv_group(spark, [path], names, utf8).select(*names)
    lines = csv_lines(spark, path)
    states = block_states(csv_blocks(lines).collect())
    text = F.col("record").cast("string") if utf8 else F.decode("record", "ISO-8859-1")
    ddl = ", ".join(f"c{i} string" for i in range(len(names)))
    mine = csv_records(lines, states).where("ord > 0").orderBy("ord").select(
        F.from_csv(F.regexp_replace(text, r"\r(?=\n|\z)", ""), ddl, {"escape": '"'}).alias("r")
    ).select("r.*")
    return [tuple(r) for r in whole.collect()], [tuple(r) for r in mine.collect()], states


def test_blocks_give_the_cells_of_the_whole_file(spark, tmp_path):
    names = ["title", "abstract", "contributors", "publicationDate", "doi"]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    crossing = 0
    try:
        for seed, end in ((1, "\n"), (2, "\r\n"), (3, "\n")):
            path = tmp_path / f"{seed}.csv"
            path.write_bytes(_file(random.Random(seed), 250, end).encode("utf-8" if seed < 3 else "latin-1"))
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            whole, mine, states = _both(spark, str(path), names, seed < 3)
            assert mine == whole and len(whole) > 200
            assert len(states) == 1 and len(next(iter(states.values()))) > 5  # several tasks read the file
            crossing += sum(next(iter(states.values())).values())
        assert crossing > 0  # some block began inside of quotes
        big = tmp_path / "big.csv"
        big.write_text('title,abstract\n"Title with a long cell","' + "line of the cell\n" * 2000 + '"\nAnother title,short\n"Never closed,x\ny')
        rows = read_csv_exports(spark, str(big)).orderBy("ingest_ord").collect()
        assert [r["title"] for r in rows] == ["Title with a long cell", "Another title", "Never closed,x\ny"]
        assert len(rows[0]["summary"]) == len("line of the cell\n") * 2000 - 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_states_after_a_line():
    cases = [
        (b'a,b', False, True), (b'a,"b', True, False), (b'"a""b",c', False, False), (b'"a"",c', True, False), (b'x"y', False, False),
        (b'"a" b,"c', True, True), (b'', False, True), (b'",', True, False), (b'"', True, False), (b'""', False, True),
        (b'a" x, "b",c', False, False),
    ]
    for line, outside, inside in cases:
        assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside), line


def test_lone_carriage_returns_and_unknown_blocks(spark, tmp_path):
    (tmp_path / "mac.csv").write_bytes(b"title,abstract\rAn old title,text\rAnother old title,more")
    assert sorted(r["title"] for r in read_csv_exports(spark, str(tmp_path)).collect()) == ["An old title", "Another old title"]
    (tmp_path / "long.csv").write_text("title\n" + "Some title here\n" * 3000)
    lines = csv_lines(spark, str(tmp_path / "long.csv")).withColumn("block", F.lit(7).cast("bigint"))
    try:
        csv_records(lines, {}).count()
        raise AssertionError("a block that was not profiled went through")
    except Exception as error:  # noqa: BLE001
        assert "split in another way" in str(error)
