import datetime as dt

import numpy as np
import pytest

from reelsift.operators.devices import DeviceCapabilities, choose_device
from reelsift.errors import GPUDependencyError
from reelsift.schema import FRAME_SCHEMA, frame_row, to_array
from reelsift.sources import video as V


def arrays(n=4, size=(6, 8)):
    return [np.random.default_rng(i).integers(0, 256, (*size, 3), dtype=np.uint8) for i in range(n)]


def test_y4m_round_trip(spark, tmp_path):
    made = [frame_row(a, i, dt.timedelta(seconds=i), v) for v in ("one.mp4", "two") for i, a in enumerate(arrays())]
    made.append(frame_row(np.zeros((3, 3, 3), np.uint8), 9, dt.timedelta(0), "two"))  # another size: skipped
    out = {r.source_video_id: (r.path, r.written, r.skipped) for r in V.write_video(spark.createDataFrame(made, FRAME_SCHEMA), str(tmp_path), 25).collect()}
    assert out["one.mp4"][1:] == (4, 0) and out["two"][1:] == (4, 1)
    back = sorted(V.load_video_frames(spark, out["two"][0]).collect(), key=lambda r: r.frame_number)
    assert [r.timestamp for r in back] == [dt.timedelta(seconds=i / 25) for i in range(4)] and back[1].additional_metadata == {"raw_frame_index_from_loader": "1"}
    for r, a in zip(back, arrays(), strict=True):
        assert np.abs(to_array(r.frame).astype(int) - a).max() <= 3  # colour conversion rounds
    assert V.load_video_frames(spark, str(tmp_path)).select("source_video_id").distinct().count() == 2


def test_pictures_and_arrays(spark, tmp_path):
    a = arrays(2)
    (tmp_path / "p.ppm").write_bytes(b"".join(b"P6\n# note\n8 6\n255\n" + x.tobytes() for x in a))
    (tmp_path / "g.pgm").write_bytes(b"P5 8 6 255\n" + a[0][:, :, 0].tobytes())
    np.save(tmp_path / "n.npy", np.stack(a))
    for name, want in (("p.ppm", a), ("g.pgm", [a[0][:, :, 0]]), ("n.npy", a)):
        rows = sorted(V.load_video_frames(spark, str(tmp_path / name), "id").collect(), key=lambda r: r.frame_number)
        assert all((to_array(r.frame) == x).all() for r, x in zip(rows, want, strict=True)) and rows[0].source_video_id == "id"
    swapped = V.extract_frames(spark, str(tmp_path / "p.ppm")).orderBy("frame_number").first()
    assert (to_array(swapped.frame) == a[0][:, :, ::-1]).all()


def test_subsampled_y4m(spark, tmp_path):
    (tmp_path / "m.y4m").write_bytes(b"YUV4MPEG2 W4 H2 F30:1 C420\nFRAME\n" + bytes([100] * 8 + [128] * 2 + [128] * 2))
    assert (to_array(V.load_video_frames(spark, str(tmp_path / "m.y4m")).first().frame) == 100).all()


def test_sources_and_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        V.load_video_frames(spark, str(tmp_path / "none.y4m"))
    (tmp_path / "a.mp4").write_bytes(b"")
    with pytest.raises(RuntimeError, match="decoder"):
        V.load_video_frames(spark, str(tmp_path / "a.mp4"))
    assert V.extract_frames(spark, str(tmp_path / "a.mp4")).count() == 0
    rows = [frame_row(a, i, dt.timedelta(0), "v") for i, a in enumerate(arrays(2))]
    assert V.frames_from(spark, rows).count() == 2 and V.frames_from(spark, iter(rows)).count() == 2
    df = V.frames_from(spark, rows)
    assert V.frames_from(spark, df) is df
    with pytest.raises(TypeError):
        V.frames_from(spark, 5)
    with pytest.raises(ValueError, match="no frames"):
        V.write_video(spark.createDataFrame([], FRAME_SCHEMA), str(tmp_path))
    with pytest.raises(Exception, match="must be"):
        V.write_video(spark.createDataFrame([frame_row(np.zeros((2, 2)), 0, dt.timedelta(0), "v")], FRAME_SCHEMA), str(tmp_path)).collect()


def test_devices():
    DeviceCapabilities.reset_cache()
    assert choose_device("cpu") == "cpu" and DeviceCapabilities.get_info()["available"] == DeviceCapabilities.is_available()
    if not DeviceCapabilities.is_available():
        assert choose_device() == "cpu"
        with pytest.raises(GPUDependencyError):
            choose_device("cuda")
