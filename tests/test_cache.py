"""Annotation caches: prediction matrices and serialised objects in both byte orders."""

import gzip
import struct

import pytest

from helixframe import render
from helixframe.sources import vep
from helixframe.sources.binary import register

ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def matrix(cells: dict[tuple[int, str], tuple[int, int]], length: int) -> bytes:
    out = [0xFFFF] * (length * 20)
    for (position, acid), (kind, score) in cells.items():
        out[(position - 1) * 20 + ACIDS.index(acid)] = kind << 14 | score
    return b"VEP" + struct.pack(f"<{len(out)}H", *out)


def test_prediction_matrix():
    raw = matrix({(1, "A"): (1, 50), (2, "Y"): (0, 1000), (3, "C"): (3, 0)}, 3)
    expected = [(1, "A", "deleterious", 0.05), (2, "Y", "tolerated", 1.0), (3, "C", "deleterious - low confidence", 0.0)]
    for one in (raw, gzip.compress(raw)):
        assert [tuple(x.values()) for x in vep.prediction_matrix(one, "sift")] == expected
    assert [x["prediction"] for x in vep.prediction_matrix(raw, "polyphen_humvar")] == ["possibly damaging", "probably damaging", "unknown"]


@pytest.mark.parametrize("raw", [b"", b"VEP", b"XYZ" + bytes(40), matrix({}, 2), matrix({(1, "A"): (0, 1)}, 1)[:-1], b"\x1f\x8bbroken", gzip.compress(matrix({(1, "A"): (0, 1)}, 1))[:-9]])
def test_no_matrix(raw):
    assert vep.prediction_matrix(raw, "sift") is None


def test_no_known_analysis():
    assert vep.prediction_matrix(matrix({(1, "A"): (0, 1)}, 1), "other") is None


def test_predictions_spelt_out():
    good = {"position": 4, "amino_acid": "K", "prediction": "benign", "score": "0.25"}
    bad = [{"position": None, "amino_acid": "K", "prediction": "x", "score": 1}, {"position": 1, "amino_acid": "K", "prediction": "x"}, 7]
    expected = [good | {"score": 0.25}]
    assert vep.predictions([good, *bad], "polyphen") == vep.predictions({"predictions": [good, *bad]}, "polyphen") == expected
    assert vep.predictions(None, "sift") is None and vep.predictions([], "sift") is None and vep.predictions(bad, "sift") is None


def test_translations_with_predictions(spark, tmp_path):
    raw = gzip.compress(matrix({(2, "W"): (1, 7)}, 2), mtime=0)
    plain = matrix({(1, "C"): (2, 900)}, 1)
    scored = {"peptide": "MW", "protein_function_predictions": {"sift": {"matrix": raw, "analysis": "sift"}, "polyphen_humvar": {"matrix": plain}}}
    rows = [{"stable_id": f"T{k}", "start": k, "end": k + 9, "strand": 1, "biotype": "protein_coding", "translation": {"stable_id": f"P{k}"}, "_variation_effect_feature_cache": c} for k, c in ((1, scored), (2, {}))]
    path = render.vep_cache(str(tmp_path / "cache"), {"1": rows}, {}, "chr")
    register(spark)
    found = spark.read.format("vep_cache").option("entity", "translation").load(path).orderBy("start").collect()
    assert [tuple(x) for x in found[0].sift_predictions] == [(2, "W", "deleterious", pytest.approx(0.007))]
    assert [tuple(x) for x in found[0].polyphen_predictions] == [(1, "C", "benign", pytest.approx(0.9))]
    assert found[0].protein_len == 2 and found[1].sift_predictions is None and found[1].polyphen_predictions is None
    few = spark.read.format("vep_cache").option("entity", "translation").option("columns", "transcript_id,sift_predictions").load(path)
    assert few.columns == ["transcript_id", "sift_predictions"] and few.count() == 2
    # the objects themselves stay text
    assert spark.read.format("vep_cache").option("entity", "transcript").load(path).where("raw_object_json like '%protein_function%'").count() == 1


@pytest.mark.parametrize("order,named", [("<", b"12345678"), (">", b"87654321")])
def test_native_order(order, named):
    u32 = lambda n: struct.pack(order + "I", n)
    key = lambda k: u32(len(k)) + k
    wide = b"\x06" + struct.pack(order + "q", -(1 << 40)) + key(b"wide")
    real = b"\x07" + struct.pack(order + "d", 0.125) + key(b"real")
    text = b"\x0a\x03abc" + key(b"text")
    net = b"\x09" + struct.pack(">i", -77777) + key(b"net")
    yes, none = b"\x0f" + key(b"yes"), b"\x0e" + key(b"none")
    flagged = b"\x04\x19\x00" + u32(1) + b"\x08\x85" + b"\x00" + key(b"x") + key(b"flags")
    blessed = b"\x04\x11\x04Some\x03" + u32(0) + key(b"object")
    again = b"\x04\x00" + struct.pack(">I", 1) + key(b"again")  # the object numbered 1 is the value of "wide"
    body = b"\x03" + u32(9) + wide + real + text + net + yes + none + flagged + blessed + again
    head = b"pst0" + bytes((4, 11, len(named))) + named + bytes((4, 8, 8, 8))
    found = vep.decode(head + body)
    assert found == {"wide": -(1 << 40), "real": 0.125, "text": "abc", "net": -77777, "yes": 1, "none": None, "flags": {"x": 5}, "object": {"__class": "Some"}, "again": -(1 << 40)}


def test_unknown_order_is_an_error():
    with pytest.raises(ValueError, match="byte order"):
        vep.decode(b"pst0\x04\x0b\x04abcd\x04\x08\x08\x08\x05")
