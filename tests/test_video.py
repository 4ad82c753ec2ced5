import numpy as np
import pytest

from reelscope.config import Sampling
from reelscope.operators.thinning import sampled, until_failure
from reelscope.sources import images, video


def write_y4m(path, frames, width, height, rate="25:1", colours="444", line=b"FRAME\n"):
    rng = np.random.default_rng(frames + width)
    across, down = video.SHARED[colours] or (0, 0)
    sizes = [height * width] + ([-(-height // down) * -(-width // across)] * 2 if across else [])
    planes = [[rng.integers(0, 256, n, dtype=np.uint8) for n in sizes] for _ in range(frames)]
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(f"YUV4MPEG2 W{width} H{height} F{rate} Ip A1:1 C{colours}\n".encode() + b"".join(line + b"".join(p.tobytes() for p in own) for own in planes))
    return planes


def plain_pixel(planes, k, row, column, width, colours):
    across, down = video.SHARED[colours] or (1, 1)
    y = int(planes[k][0][row * width + column]) - 16
    at = (row // down) * -(-width // across) + column // across
    u, v = (int(planes[k][1][at]) - 128, int(planes[k][2][at]) - 128) if len(planes[k]) == 3 else (0, 0)
    return [min(255, max(0, round(x))) for x in (1.164 * y + 2.017 * u, 1.164 * y - 0.392 * u - 0.813 * v, 1.164 * y + 1.596 * v)]


@pytest.mark.parametrize("colours", ["444", "422", "420jpeg", "mono"])
def test_pixels_by_their_definition(tmp_path, colours):
    planes = write_y4m(tmp_path / "a.y4m", 4, 7, 5, "30000:1001", colours)
    own = video.Y4mDecoder()
    rate, n = own.open(str(tmp_path / "a.y4m"))
    assert rate == pytest.approx(29.97, abs=0.01) and n == 4
    for k in (3, 0, 2):
        content, pixels = own.frame(str(tmp_path / "a.y4m"), k)
        assert [[pixels[r, c].tolist() for c in range(7)] for r in range(5)] == [[plain_pixel(planes, k, r, c, 7, colours) for c in range(7)] for r in range(5)]
        assert content == b"P6\n7 5\n255\n" + pixels[:, :, ::-1].tobytes()
    assert own.frame(str(tmp_path / "a.y4m"), 4) is None and own.frame(str(tmp_path / "a.y4m"), -1) is None


def test_videos_as_rows(spark, tmp_path):
    planes = {name: write_y4m(tmp_path / name / f"{name}.y4m", n, 6, 4, rate) for name, n, rate in (("a", 23, "5:1"), ("b", 9, "2:1"), ("slow", 9, "1:4"))}
    whole = (tmp_path / "b" / "b.y4m").read_bytes()
    (tmp_path / "b" / "cut.y4m").write_bytes(whole[:-5])  # the last frame is not whole
    start = whole.index(b"\n") + 1
    (tmp_path / "b" / "bad.y4m").write_bytes(whole[: start + 4 * 78] + b"XXXXX\n" + whole[start + 4 * 78 + 6 :])  # frame 4 is none
    for name, data in (("empty", b""), ("text", b"no video\n"), ("norate", b"YUV4MPEG2 W4 H4\n"), ("zero", b"YUV4MPEG2 W4 H4 F0:0\n"), ("none", b"YUV4MPEG2 W4 H4 F5:1\n")):
        (tmp_path / "b" / f"{name}.y4m").write_bytes(data)
    (tmp_path / "b" / "notes.txt").write_bytes(b"x")
    found = video.read_videos(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 10
    rows = {(r["video_id"], r["frame_index"]): r for r in found.collect()}
    assert sorted(rows) == [("a", k) for k in range(0, 23, 5)] + [("b", k) for k in range(0, 9, 2)] + [("bad", 0), ("bad", 2)] + [("cut", k) for k in range(0, 8, 2)]
    for (name, k), r in rows.items():
        own = planes["a" if name == "a" else "b"]
        assert [list(r["pixels"][3 * c : 3 * c + 3]) for c in range(24)] == [plain_pixel(own, k, c // 6, c % 6, 6, "444") for c in range(24)]
        assert (r["height"], r["width"], r["frame_ms"]) == (4, 6, int(k / (5 if name == "a" else 2) * 1000))
    # the same frames as sampling by expressions gives, and as far
    told = spark.createDataFrame([("a", 5.0, 23), ("b", 2.0, 9), ("slow", 0.25, 9)], "video_id string, fps double, frames int")
    assert sorted((r["video_id"], r["frame_index"], r["frame_ms"]) for r in sampled(told, 1.0).collect()) == sorted((v, k, r["frame_ms"]) for (v, k), r in rows.items() if v in "ab")
    every = spark.createDataFrame([("bad", k, None if k == 4 else "ok") for k in range(0, 9, 2)], "video_id string, frame_index long, seen string")
    assert [r["frame_index"] for r in until_failure(every, "seen").orderBy("frame_index").collect()] == [k for v, k in sorted(rows) if v == "bad"]
    assert video.read_videos(spark, str(tmp_path / "a" / "a.y4m"), interval=2.0).count() == 3


def test_empty_folder_and_another_decoder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert video.read_videos(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "v.raw").write_bytes(bytes(range(6)))

    class Bytes:
        """Each byte of a file is a frame of one pixel."""

        def open(self, path):
            return 1.0, 6

        def frame(self, path, index):
            value = open(path, "rb").read()[index]
            return (b"%d" % value, np.full((1, 1, 3), value, np.uint8)) if value != 4 else None

    got = video.read_videos(spark, str(tmp_path), source=video.reader_of(Bytes(), "bytes"), ending=".raw").collect()
    assert [(r["video_id"], r["frame_index"], bytes(r["content"]), bytes(r["pixels"])) for r in got] == [("v", k, b"%d" % k, bytes([k] * 3)) for k in range(4)]


def test_extraction_of_y4m_files(spark, tmp_path):
    write_y4m(tmp_path / "v" / "v.y4m", 6, 130, 130, "1:1")
    videos = spark.createDataFrame([("v", str(tmp_path / "v" / "v.y4m")), ("gone", str(tmp_path / "gone.y4m"))], "video_id string, path string")
    got = images.extraction(videos, video.Y4mDecoder(), Sampling(change=-1.0)).collect()
    assert [(r["frame_ms"], bytes(r["content"][:2])) for r in got[:-1]] == [(k * 1000, b"P6") for k in range(6)] and (got[-1]["saved"], got[-1]["skipped"]) == (6, 0)
