import os

from presence.sources import scan
from presence.workload import inputs, views
from presence.workload.base import REGISTRY


def test_bitmaps_hold_the_text(spark, tmp_path):
    """Images go to Python as text, a character a pixel, and come out as files
    of the same pixels; one in seventeen is cut off."""
    texts = {1: "abä€\U0001f600" * 300, 2: "x", 17: "cut"}
    rows = [(k, t) for k, t in texts.items()] + [(3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planes = views.text_planes(spark, str(tmp_path))
    assert planes.schema["gray"].dataType.simpleString() == "string"
    sizes = {r["image_id"]: (r["h"], r["w"], len(r["gray"])) for r in planes.collect()}
    assert sizes == {1: (24, 64, 1536), 2: (16, 64, 1024), 17: (16, 64, 1024)}
    root = inputs.bmp_folder(spark, str(tmp_path))
    assert sorted(os.listdir(f"{root}/original")) == ["1.BMP", "17.BMP"] and os.listdir(f"{root}/attack") == ["2.BMP"]
    with open(f"{root}/original/1.BMP", "rb") as f:
        body = f.read()[54:]
    want = [ord(texts[1][i % 1500]) % 256 for i in range(1536)]
    top_line = body[-192:]  # lines stand from the bottom up
    assert list(top_line[::3]) == want[:64] and list(body[:192:3]) == want[-64:]
    with open(f"{root}/original/17.BMP", "rb") as f:
        assert f.read() == b"BM broken"


def test_folders_are_small_and_scanned_in_turn(spark, tmp_path, monkeypatch):
    """No frame lists more than a group of folders, and no file is left out."""
    rows = [(k, f"text {k} ") for k in range(1, 401)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(inputs, "PER_FOLDER", 4)
    root, folders = inputs.bmp_folders(spark, str(tmp_path))
    files = {f: os.listdir(f) for f in folders}
    assert sorted(n for names in files.values() for n in names) == sorted(f"{k}.BMP" for k, _ in rows)
    assert max(map(len, files.values())) <= 16 and len(folders) > 2 * scan.FOLDERS_AT_ONCE
    assert {os.path.basename(f) for f in folders} == {"attack", "original"} and all(f.startswith(root) for f in folders)

    listed, plain = [], scan.scan_images

    def watched(spark, path, recursive=False):
        listed.append(path)
        return plain(spark, path, recursive)

    monkeypatch.setattr(scan, "scan_images", watched)
    got = REGISTRY["scan_images"].build(spark, str(tmp_path)).collect()
    assert sorted(r["file"] for r in got) == sorted(f"{k}.BMP" for k, _ in rows)
    sets = {r["class"]: (r["ok"], r["n"]) for r in REGISTRY["scan_labelled_sets"].build(spark, str(tmp_path)).collect()}
    broken = [k for k, _ in rows if k % 17 == 0]
    assert sets == {"REAL": (200 - sum(k % 2 for k in broken), 200), "SPOOF": (200 - sum(1 - k % 2 for k in broken), 200)}
    assert len(listed) > 4 and all(len(paths) <= scan.FOLDERS_AT_ONCE for paths in listed)
