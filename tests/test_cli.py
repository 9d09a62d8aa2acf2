import json

from strail.cli import main


def test_generate_load_query(spark, tmp_path, capsys):
    u, s, i = (str(tmp_path / n) for n in "usi")
    main(["generate", "--output", u, "-n", "400", "-m", "50", "-l", "3"], spark)
    main(["shuffle", "--input", u, "--output", s], spark)
    assert spark.read.parquet(s).select("trajectory_id").distinct().count() == spark.read.parquet(u).select("trajectory_id").distinct().count()
    main(["load", "--input", s, "--output", i, "--leaf-fanout", "20", "--limit", "300"], spark)
    assert json.loads(capsys.readouterr().out)["units"] == 300
    main(["query", "--index", i, "-r", "MIN,MAX,MIN,MAX,MIN,MAX", "-l", "", "--stats"], spark)
    assert json.loads(capsys.readouterr().out)["units"] == 300
    main(["query", "--index", i, "-r", "MIN,MAX,MIN,MAX,MIN,MAX", "-l", "1"], spark)
    assert "Found" in capsys.readouterr().out
    main(["stats", "--index", i], spark)
    assert json.loads(capsys.readouterr().out)["entry_count"] == 300
    main(["dump", "--index", i], spark)
    assert "node 0" in capsys.readouterr().out
