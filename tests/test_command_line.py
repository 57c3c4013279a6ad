import csv
import glob
import json

import numpy as np
import pytest

from voxmill.__main__ import main
from voxmill.sources import formats, listing, volumes


def test_from_volume_to_tables(spark, tmp_path):
    data = np.zeros((24, 24, 24), np.uint8)
    data[4:20, 6:18, 6:18] = 7
    data[0:3, 0:3, 0:3] = 9
    volumes.write_zarr(f"{tmp_path}/v.zarr/s0", data, (16, 16, 16), {"voxel_size": [4, 4, 4], "offset": [100, 200, 300]})
    main(["meshes", f"{tmp_path}/v.zarr/s0", f"{tmp_path}/meshes"], spark)
    v, f = formats.unpacked_mesh((tmp_path / "meshes/7").read_bytes())
    assert v.min(0).tolist() == [322, 222, 114] and v.max(0).tolist() == [370, 270, 178]
    assert json.loads((tmp_path / "meshes/7:0").read_text()) == {"fragments": ["7"]}
    for name in ("info", "7:0", "9:0"):
        (tmp_path / "meshes" / name).unlink()
    files = {r.segment_id: r.n_bytes for r in listing.segment_files(spark, f"file://{tmp_path}/meshes").collect()}
    assert files == {7: (tmp_path / "meshes/7").stat().st_size, 9: (tmp_path / "meshes/9").stat().st_size}
    (tmp_path / "p.csv").write_text("Object ID,kind\n7,rod\n")
    main(["levels", f"{tmp_path}/meshes", f"{tmp_path}/levels", "--lods", "2", "--properties", f"{tmp_path}/p.csv"], spark)
    _, _, listed = formats.unpacked_index((tmp_path / "levels/7.index").read_bytes())
    assert sum(int(s.sum()) for _, s in listed) == (tmp_path / "levels/7").stat().st_size > 0
    doc = json.loads((tmp_path / "levels/segment_properties/info").read_text())["inline"]
    assert doc["ids"] == ["7", "9"] and doc["properties"][0]["values"] == ["rod", ""]
    main(["skeletons", f"{tmp_path}/meshes", f"{tmp_path}/skeletons", "--least-branch", "5", "--tolerance", "1"], spark)
    assert len(formats.unpacked_skeleton((tmp_path / "skeletons/skeletons/7").read_bytes())[0]) >= 2
    main(["analyze", f"{tmp_path}/meshes", f"{tmp_path}/analysis"], spark)
    with open(glob.glob(f"{tmp_path}/analysis/metrics/*.csv")[0]) as held:
        rows = list(csv.DictReader(held))
    assert [r["segment_id"] for r in rows] == ["7", "9"] and float(rows[0]["volume"]) > 0.9 * 16 * 12 * 12 * 64


def test_regions():
    assert listing.parsed_region("1 2 3, 4 5 6") == ((1, 2, 3), (4, 5, 6))
    assert listing.normalised_region({"offset": [1, 1, 1], "shape": [2, 3, 4]}) == ((1, 1, 1), (3, 4, 5))
    for bad in ({}, {"begin": [1]}):
        with pytest.raises(ValueError):
            listing.normalised_region(bad)
    with pytest.raises(ValueError):
        listing.parsed_region("1 2")
