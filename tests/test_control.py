import io
import json

import pytest

from tallylog.cli import run
from tallylog.control.config import FILE_NAME, Config, ConfigError, Named, find_config, load_config, parse_config

TOML = """
theme = "dark"
columns = ["timestamp", "level"]
[aliases]
noisy = "service:health"
[aliases.oncall]
query = "level:error AND last:15m"
columns = ["service"]
[trace]
id_fields = ["req"]
[views]
b = "level:warn"
[views.a]
query = "level:error"
columns = ["message"]
"""


def test_config(tmp_path):
    c = parse_config(TOML)
    assert (c.theme, c.columns, c.id_names()) == ("dark", ("timestamp", "level"), ("req",))
    assert c.aliases == {"noisy": Named("service:health"), "oncall": Named("level:error AND last:15m", ("service",))}
    assert c.view_keys() == {"1": "a", "2": "b"} and c.registry().expand("@noisy") == "(service:health)"
    assert parse_config("") == Config() and load_config(None) == Config() and "trace_id" in Config().id_names()
    for bad in ("[aliases]\nx = 1", "[views]\nx = [1]", "not toml ="):
        with pytest.raises(ConfigError):
            parse_config(bad)
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / FILE_NAME).write_text(TOML)
    assert find_config(tmp_path / "a" / "b") == tmp_path / FILE_NAME and load_config(tmp_path / FILE_NAME) == c


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    path = tmp_path_factory.mktemp("cli") / "app.jsonl"
    path.write_text("".join(f'{{"ts":"2026-03-08T10:00:0{i}Z","level":"{x}","service":"{s}","message":"took {i}ms"}}\n' for i, (x, s) in enumerate([("error", "api"), ("info", "api"), ("error", "db"), ("fatal", "db")])))
    return str(path)


def cli(spark, *args, stdin="", config=None):
    out, err = io.StringIO(), io.StringIO()
    code = run(list(args), spark, io.StringIO(stdin), out, err, config or Config())
    return code, out.getvalue(), err.getvalue()


def test_commands(spark, log, tmp_path):
    assert cli(spark, log, "-q", "@err", "--count") == (0, "3\n", "")
    assert cli(spark, log, "--count")[1] == "4\n"
    assert cli(spark, log, "-q", "level:error", "--group-by", "service")[1] == "VALUE  COUNT\napi    1\ndb     1\n"
    assert cli(spark, log, "--patterns", "--format", "csv")[1] == "template,count\ntook <duration>,4\n"
    assert cli(spark, log, "-q", "service:db", "--format", "csv", "--columns", "level,service")[1] == "level,service\nerror,db\nfatal,db\n"
    assert json.loads(cli(spark, log, "-q", "level:fatal", "--format", "json")[1])["service"] == "db"
    target = tmp_path / "out.txt"
    assert cli(spark, log, "-q", "level:fatal", "-o", str(target)) == (0, "", f"1 records written to {target}\n") and target.read_text().count("\n") == 1
    assert cli(spark, stdin="level=error a=1\nlevel=info a=2\n")[1] == "level=error a=1\nlevel=info a=2\n"


def test_order_of_modes(spark, log):
    assert cli(spark, log, "--count", "--patterns", "--group-by", "level")[1] == "4\n"
    assert cli(spark, log, "--patterns", "--group-by", "level", "--top", "1")[1] == " COUNT  TEMPLATE\n     4  took <duration>\n"


def test_views(spark, log):
    config = Config(views={"bad": Named("level:fatal", ("level",))})
    assert cli(spark, log, "--view", "1", "--format", "csv", config=config)[1] == "level\nfatal\n" == cli(spark, log, "--view", "bad", "--format", "csv", config=config)[1]


def test_errors(spark, log):
    for args in (("-q", "(a"), ("-q", "@nope"), ("--format", "xml"), ("--view", "9")):
        code, out, err = cli(spark, log, *args)
        assert code == 1 and out == "" and err
    assert cli(spark, stdin="\n\n") == (1, "", "No records found.\n")


def test_diff(spark, log):
    code, out, _ = cli(spark, "diff", log, log, "-q", "level:error", "--format", "json")
    assert code == 0 and json.loads(out)["left"] == {"name": "app.jsonl", "records": 2, "patterns": 1}
    assert "Level Distribution" in cli(spark, "diff", log, log)[1]
