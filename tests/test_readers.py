import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift.operators import inject
from skydrift.sources import fits, readers


def test_small_inputs(spark, tmp_path):
    (tmp_path / "events.txt").write_text("/a/b.fits\n\n  /c.fits \n")
    assert sorted(r.path for r in readers.event_manifest(spark, f"{tmp_path}/events.txt").collect()) == ["/a/b.fits", "/c.fits"]
    (tmp_path / "none.txt").write_text("\n \n")
    with pytest.raises(ValueError):
        readers.event_manifest(spark, f"{tmp_path}/none.txt")
    (tmp_path / "c.csv").write_text("tile_id,ra_degrees,dec_degrees\nroi_001,1.5,-2\n")
    assert tuple(readers.ownership_centres(spark, f"{tmp_path}/c.csv").first()) == ("roi_001", 1.5, -2.0)
    (tmp_path / "e.csv").write_text("tile_id,ra_degrees,dec_degrees\n")
    with pytest.raises(ValueError):
        readers.ownership_centres(spark, f"{tmp_path}/e.csv")
    for k in (1, 2):
        (tmp_path / f"scramble_00001/roi_00{k}").mkdir(parents=True)
        (tmp_path / f"scramble_00001/roi_00{k}/query_info.json").write_text(json.dumps({"tile_id": f"roi_00{k}", "ra_degrees": 1.0 * k}, indent=1))
        (tmp_path / f"scramble_00001/roi_00{k}/candidates.json").write_text(json.dumps([{"track_length": 5 + i, "points": [{"bin_index": i}]} for i in range(k)], indent=1))
    assert readers.tile_descriptions(spark, f"{tmp_path}/scramble_00001/*/query_info.json").count() == 2
    got = {r._candidate_id: r.track_length for r in readers.track_files(spark, f"{tmp_path}/scramble_00001/*/candidates.json").collect()}
    assert got == {"scramble_00001/roi_001_candidate_001": 5, "scramble_00001/roi_002_candidate_001": 5, "scramble_00001/roi_002_candidate_002": 6}
    (tmp_path / "truth.json").write_text(json.dumps({"per_bin_truth": [{"bin_index": 3, "ra": 1.5, "dec": 2.5}]}, indent=1))
    assert tuple(readers.injected_truth(spark, f"{tmp_path}/truth.json").first()) == (3, 1.5, 2.5)
    (tmp_path / "y.csv").write_text("x,y\n1,2.5\n")
    assert tuple(readers.yield_table(spark, f"{tmp_path}/y.csv").first()) == (1.0, 2.5)
    assert readers.first_existing([None, "/nowhere", f"{tmp_path}/y.csv"]) == f"{tmp_path}/y.csv"
    with pytest.raises(FileNotFoundError):
        readers.first_existing(["/nowhere"])


def test_point_spread_file(spark, tmp_path):
    ne, nt = 3, 2
    cell = lambda v: (f"{ne * nt}D", np.full((1, ne * nt), v) + np.arange(ne * nt) * 0.01)
    table = {"ENERG_LO": (f"{ne}D", [[100.0, 1000.0, 10000.0]]), "ENERG_HI": (f"{ne}D", [[1000.0, 10000.0, 100000.0]]), "CTHETA_LO": (f"{nt}D", [[0.2, 0.6]]), "CTHETA_HI": (f"{nt}D", [[0.6, 1.0]]),
             "NTAIL": cell(0.1), "SCORE": cell(0.6), "STAIL": cell(1.4), "GCORE": cell(2.2), "GTAIL": cell(1.8)}
    fits.write_fits(f"{tmp_path}/psf.fits", {"RPSF_FRONT": table, "PSF_SCALING_PARAMS_FRONT": {"PSFSCALE": ("3D", [[0.05, 0.0003, -0.8]])}})
    k = readers.king_table(f"{tmp_path}/psf.fits", "FRONT")
    assert k.costheta == (0.4, 0.8) and abs(k.log_energy[1] - 3.5) < 1e-12 and abs(k.cells["SCORE"][1][2] - 0.65) < 1e-12
    assert abs(sum(w for w, _, _ in k.parts(3000.0, 45.0)) - 1) < 1e-12
    far = spark.range(1).select(inject.containment(F.lit(89.0), k, 3000.0, 45.0).alias("c")).first().c
    assert 0.99 < far <= 1


def test_template_guards_and_routing(spark):
    p = spark.createDataFrame([(b, 10.0, 5.0) for b in range(3)], "bin_index int, ra double, dec double")
    inject.check_template(p, 10.0, 5.0, 2.0, 3)
    with pytest.raises(ValueError):
        inject.check_template(p, 50.0, 5.0, 2.0, 3)
    with pytest.raises(ValueError):
        inject.check_template(p, 10.0, 5.0, 2.0, 4)
    m = spark.createDataFrame([("a",), ("b",)], "tile_id string")
    h = spark.createDataFrame([("b",), ("c",)], "cap_tile string")
    assert {(r.tile_id, r.problem) for r in inject.unrouted(m, h).collect()} == {("a", "no rows"), ("c", "no membership")}
    a, d = inject.track_midpoint(359.9, 60.0, 0.5, 10.0, 1.0, 0.5)
    assert abs(a - (359.9 + 1 / math.cos(math.radians(60.5))) % 360) < 1e-12 and d == 60.5
