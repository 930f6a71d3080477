"""The command line's settings."""

import json

import pytest

from weirlight import cli


def test_settings(capsys):
    assert cli.main(["settings", "--set", "window.size=8"]) == 0
    assert json.loads(capsys.readouterr().out)["window"]["size"] == 8
    with pytest.raises(ValueError):
        cli.main(["settings", "--set", "window.size=7"])
