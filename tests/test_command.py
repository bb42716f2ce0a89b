import numpy as np
import pytest

from plumbline.__main__ import main


def test_two_files_and_a_script(spark, tmp_path, capsys):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    y = np.where(x[:, 0] * 2 + rng.normal(size=90) > 0, "disease", "control")
    (tmp_path / "x.csv").write_text("\n".join(["sample_id,a,b,c,d", *(f"s{i}," + ",".join(map(str, r)) for i, r in enumerate(x))]))
    (tmp_path / "m.csv").write_text("\n".join(["sample_id,diagnosis,patient_id,plate", *(f"s{i},{y[i]},p{i // 3},{'uv'[i % 2]}" for i in range(90))]))
    (tmp_path / "run.py").write_text("s = StandardScaler()\nx = s.fit_transform(x)\na, b = train_test_split(x)\n")
    paths = [str(tmp_path / n) for n in ("x.csv", "m.csv")]
    got = main([*paths, "--fast", "--no-nested", "--folds", "3", "--script", str(tmp_path / "run.py"), "--out", str(tmp_path / "out")], spark)
    assert got["task"] == "binary" and list(got["ladder"]) == ["naive", "groupkfold", "groupkfold_batchcorrected"]
    assert {f["check"]: f["severity"] for f in got["findings"]} | {"leaky_preprocessing": "critical", "subject_leakage": "critical"} == {f["check"]: f["severity"] for f in got["findings"]}
    assert (tmp_path / "out" / "report.md").read_text() + "\n" == capsys.readouterr().out
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(SystemExit, match="--id"):
        main([paths[0]], spark)
