"""Delimited text cut at any byte, against the standard library's reader; files that tables refuse."""

import csv
import io
import random

import pytest

from replylens.sources import delimited, readers


def texts(df):
    return [r.review for r in df.orderBy("source", "pos").collect()]


def write(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def random_table(chosen, n):
    """Cells with quotes, line breaks and delimiters, written with the quotes that they need or more, or stray ones."""
    lines = []
    for _ in range(n):
        cells = []
        for _ in range(chosen.randint(1, 4)):
            cell = "".join(chosen.choices(["a", "bc", "é", '"', ",", "\n", "\r\n", "\r", " ", "\U0001f600"], k=chosen.choice([0, 1, 3, 9, 60])))
            if chosen.random() < 0.2:
                cell = "".join(c for c in cell if c not in ',\n\r"') + chosen.choice(["", '"', 'x"y'])
                cells.append(cell if not cell.startswith('"') else "z" + cell)
            else:
                cells.append('"' + cell.replace('"', '""') + '"' + chosen.choice(["", "", "tail", 'o"o']))
        lines.append(",".join(cells) + chosen.choice(["\n", "\n", "\r\n", "\r", "\n\n"]))
    return "".join(lines)


@pytest.mark.parametrize("seed", range(3))
def test_records_of_split_files(spark, tmp_path, small_splits, seed):
    chosen = random.Random(seed)
    contents = [random_table(chosen, n) for n in (60, 3, 1)] + ['a,b\nc,"' + "open\n" * 49 + "open", "a\rb\rc", "\n\nx\n"]
    for i, content in enumerate(contents):
        write(tmp_path / f"{i}.csv", content)
    table = delimited.Delimited(spark, str(tmp_path))
    assert table.splits.count() > 10
    got = {}
    for r in table.rows().orderBy("source", "pos").collect():
        got.setdefault(int(r.source[-5]), []).append(list(r.cells))
    for i, content in enumerate(contents):
        assert got[i] == [row for row in csv.reader(io.StringIO(content, newline="")) if row], i
    closed = {int(r.source[-5]): not r.unclosed for r in table.files().collect()}
    assert closed == {i: i != 3 for i in range(len(contents))}


def test_states_of_lines():
    for line in (b"", b"a,b", b'"a', b'a"b', b'a,"b', b'"a""', b'"a"",b', b'"a""",b', b'"a"b"c,"d', b',"', b'","', b'"",""', b'x,"a",y"', b'"a" "b'):
        for inside in (False, True):
            rows = list(csv.reader(io.StringIO(('"' if inside else "") + line.decode() + "\n~,~,~", newline="")))
            assert delimited.ends_inside(line, inside) == (rows[-1] != ["~", "~", "~"]), (line, inside)


def test_positions_do_not_depend_on_tasks(spark, tmp_path, small_splits):
    path = write(tmp_path / "a.csv", "".join(f'{i},"x\n{i}"\n' for i in range(100)))
    got = readers.read_cells(spark, path).orderBy("pos").collect()
    assert [r.cells[1] for r in got] == [f"x\n{i}" for i in range(100)]
    assert len({r.pos for r in got}) == 100
    assert [r.pos for r in readers.read_cells(spark, path).orderBy("pos").collect()] == [r.pos for r in got]


# what the table readers refuse is read line by line
OVER_WIDE = "id,feedback\n1,x fine\n2,y,z\n3,w\n"


def test_a_row_wider_than_its_table(spark, tmp_path):
    path = write(tmp_path / "a.csv", OVER_WIDE)
    assert texts(readers.csv_with_fallbacks(spark, path)) == OVER_WIDE.split()[0:1] + ["1,x fine", "2,y,z", "3,w"]
    with pytest.raises(Exception, match="wider than its table"):
        readers.read_csv_reviews(spark, path).collect()
    # a first row that is wider than the header has cells without a name in front
    wide = write(tmp_path / "b.csv", "id,feedback\n1,x,fine\n2,y,good\n3,w\n")
    assert texts(readers.csv_with_fallbacks(spark, wide)) == ["fine", "good"] == texts(readers.read_csv_reviews(spark, wide))


def test_bytes_that_are_not_utf8(spark, tmp_path):
    path = write(tmp_path / "a.csv", b"id,feedback\n1,caf\xe9 noir\n2,good\n")
    assert texts(readers.csv_with_fallbacks(spark, path)) == ["id,feedback", "1,caf noir", "2,good"]
    assert texts(readers.read_ragged_csv(spark, path)) == ["feedback", "caf noir", "good"]
    assert texts(readers.read_lines(spark, path)) == ["id,feedback", "1,caf noir", "2,good"]
    with pytest.raises(ValueError, match="not UTF-8"):
        readers.read_csv_reviews(spark, path)
    text = write(tmp_path / "a.txt", b"caf\xe9\n\nb\xff\xfe")
    assert texts(readers.read_text_reviews(spark, text)) == ["caf", "b"] == texts(readers.read_text_reviews(spark, text, whole_files=False))
    # one bad file of a folder changes nothing for the others
    write(tmp_path / "b.csv", "id,feedback\n1,fine\n")
    assert texts(readers.csv_with_fallbacks(spark, [path, str(tmp_path / "b.csv")])) == ["id,feedback", "1,caf noir", "2,good", "fine"]


def test_quotes_that_do_not_close(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,feedback\n1,"open\n2,good\n')
    assert texts(readers.csv_with_fallbacks(spark, path)) == ["id,feedback", '1,"open', "2,good"]
    assert texts(readers.read_ragged_csv(spark, path)) == ["feedback", "open\n2,good"]
    with pytest.raises(ValueError, match="do not close"):
        readers.read_csv_reviews(spark, path)
    first = write(tmp_path / "b.csv", '"open\nnice\n')
    assert texts(readers.csv_with_fallbacks(spark, first)) == ['"open', "nice"]


def test_repeated_and_empty_names(spark, tmp_path):
    assert readers.column_names(["a", "a", "", "a.1", "a", ""]) == ["a", "a.2", "Unnamed: 2", "a.1", "a.3", "Unnamed: 5"]
    path = write(tmp_path / "a.csv", "feedback,id,feedback\nfine,1,other\n")
    assert texts(readers.read_csv_reviews(spark, path)) == ["fine"]
    assert texts(readers.reviews_from_column(readers.read_csv(spark, path), "feedback.1")) == ["other"]
    seen = readers.inspect_file(spark, path)
    assert seen.columns == ["feedback", "id", "feedback.1"] and not seen.no_header and seen.sample["feedback.1"] == ["other"]


def test_different_headers_are_refused(spark, tmp_path):
    write(tmp_path / "a.csv", "a,b\n1,2\n")
    write(tmp_path / "b.csv", "a,c\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_csv(spark, str(tmp_path))
    assert readers.data_columns(readers.read_csv(spark, str(tmp_path), header=False)) == ["0", "1"]


def test_empty_file(spark, tmp_path):
    path = write(tmp_path / "a.csv", "")
    assert readers.csv_with_fallbacks(spark, path).count() == 0 == readers.read_ragged_csv(spark, path).count()
