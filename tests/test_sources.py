"""Lines that fit and lines that don't, in both modes of the readers."""

import pytest

from tabulearn.sources import text as lines


@pytest.fixture
def folder(tmp_path):
    def write(*rows):
        (tmp_path / "lines.txt").write_text("\n".join(rows) + "\n")
        return str(tmp_path)

    return write


def split(df):
    rows = [r.asDict() for r in df.collect()]
    assert all((r["bad"] is None) != (r["label"] is None) for r in rows)
    return [r for r in rows if r["bad"] is None], sorted(r["bad"] for r in rows if r["bad"] is not None)


@pytest.mark.parametrize("read, gap", [(lines.read_labeled_tsv, "\t"), (lines.read_labeled_ws, "  ")])
def test_fields(spark, folder, read, gap):
    good = [gap.join(["1", "2.5", "0"]), "", gap.join(["-3", "1e2", "1"])]
    bad = [gap.join(["1", "2"]), gap.join(["1", "x", "0"]), gap.join(["1", "2", "3", "4"]), "word"]
    fit, rest = split(read(spark, folder(*good, *bad), 2, bad="bad"))
    assert sorted((r["f0"], r["f1"], r["label"]) for r in fit) == [(-3.0, 100.0, 1.0), (1.0, 2.5, 0.0)] and rest == sorted(bad)
    assert read(spark, folder(*good), 2).columns == ["f0", "f1", "label"] and read(spark, folder(*good), 2).count() == 2
    for line in bad:
        with pytest.raises(Exception, match="wrong number of fields, or no number"):
            read(spark, folder(*good, line), 2).collect()


def test_pixels(spark, folder):
    good, bad = ["0,255,0", "7,51,102"], ["0,256,0", "0,-1,0", "0,x,1", "0,1", "1,2,3,4", ","]
    fit, rest = split(lines.read_labeled_pixels(spark, folder(*good, *bad), n_pixels=2, bad="bad"))
    assert sorted((r["label"], r["pixels"]) for r in fit) == [(-1, [0.2, 0.4]), (1, [1.0, 0.0])] and rest == sorted(bad)
    assert lines.read_labeled_pixels(spark, folder(*good)).count() == 2
    for line in bad:
        with pytest.raises(Exception, match="no line of pixels"):
            lines.read_labeled_pixels(spark, folder(line), n_pixels=2).collect()


def test_text(spark, folder):
    rows = ["yes sunny hot", "no rain", "maybe wind", "yes"]
    fit, rest = split(lines.read_labeled_text(spark, folder(*rows), yes_no=True, bad="bad"))
    assert sorted((r["label"], r["text"]) for r in fit) == [("0", "rain"), ("1", "sunny hot")] and rest == ["maybe wind", "yes"]
    fit, rest = split(lines.read_labeled_text(spark, folder("doc1 a b", "x2", ""), bad="bad"))
    assert [(r["label"], r["text"]) for r in fit] == [("1", "a b")] and rest == ["x2"]
    assert lines.read_labeled_text(spark, folder(*rows)).count() == 4
