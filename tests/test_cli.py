import io

from relspark.cli import format_table, main


def run(spark, tmp_path, *args, stdin=""):
    out = io.StringIO()
    code = main(["-d", f"file://{tmp_path}/data", *args], io.StringIO(stdin), out, spark)
    return code, out.getvalue()


def test_precedence_and_output(spark, tmp_path):
    script = tmp_path / "a.sql"
    script.write_text("SELECT 'script' AS x")
    code, out = run(spark, tmp_path, "-c", "SELECT 'command' AS x", "-s", str(script), stdin="SELECT 'stdin' AS x")
    assert code == 0 and "command" in out and "(1 row)" in out
    assert "script" in run(spark, tmp_path, "-s", str(script), stdin="SELECT 'stdin' AS x")[1]
    assert "stdin" in run(spark, tmp_path, stdin="SELECT 'stdin' AS x")[1]


def test_errors(spark, tmp_path):
    assert run(spark, tmp_path)[0] == 2
    assert run(spark, tmp_path, "-s", "/nowhere.sql")[0] == 2
    assert run(spark, tmp_path, "-c", "SELECT * FROM nowhere")[0] == 1


def test_changes_and_json(spark, tmp_path):
    assert run(spark, tmp_path, "-c", "CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (NULL)")[1].strip() == "Inserted 2 rows"
    code, out = run(spark, tmp_path, "--json", "-c", "SELECT * FROM t WHERE a = 1")
    assert code == 0 and '"data": [{"a": 1}]' in out


def test_table():
    text = format_table(["a", "long name"], [(1, None), (22, "x")])
    assert text.splitlines()[1] == "│ a  │ long name │" and "NULL" in text and text.endswith("(2 rows)")
