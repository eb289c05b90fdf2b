"""What is read on the driver about a project: configuration, kind, and changed files."""

from __future__ import annotations

import json
import subprocess
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ravelin.sources.swift import EXCLUDE, read


@dataclass
class Config:
    """Which files are taken. Unknown entries of a file are ignored."""

    version: int = 1
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))
    index_store_path: str = "auto"

    @classmethod
    def load(cls, path: Path) -> Config:
        """The configuration in a JSON file, or the default where there is none or it cannot be read."""
        try:
            read = json.loads(Path(path).read_text())
            return cls(read.get("version", 1), read.get("include", []), read.get("exclude", []), read.get("index_store_path", "auto"))
        except (OSError, ValueError, AttributeError):
            return cls()

    def save(self, path: Path) -> None:
        """Writes the configuration, unless there is one."""
        path = Path(path)
        if not path.exists():
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(json.dumps(self.__dict__, indent=2))


def sources(spark: SparkSession, root: Path | str, config: Config | None = None) -> DataFrame:
    """path, hash and text of a project's Swift files, those that its configuration takes."""
    config = config or Config()
    return read(spark, str(root), config.include or None, config.exclude)


def project_type(root: Path) -> str:
    """tuist, xcodegen, xcode-workspace, xcode or spm, by the first marker found in that order; FileNotFoundError without any."""
    root = Path(root)
    markers = (("tuist", (root / "Tuist").is_dir()), ("xcodegen", (root / "project.yml").is_file()), ("xcode-workspace", any(root.glob("*.xcworkspace"))),
               ("xcode", any(root.glob("*.xcodeproj"))), ("spm", (root / "Package.swift").is_file()))
    for kind, found in markers:
        if found:
            return kind
    raise FileNotFoundError(f"no Swift project in {root}")


def changed(root: Path, ref: str = "unstaged") -> list[str]:
    """Swift files that git calls changed: unstaged, staged, or in a range of commits."""
    extra = {"unstaged": [], "staged": ["--cached"]}.get(ref, [ref])
    out = subprocess.run(["git", "diff", "--name-only", "--diff-filter=ACMR", *extra], cwd=root, capture_output=True, text=True, check=True).stdout
    return [f for f in out.splitlines() if f.endswith(".swift")]


def index_store(root: Path, home: Path | None = None) -> Path | None:
    """Where a project's index store is: in its build folder (spm) or under the derived data of its name, newer layouts first; None without one."""
    root = Path(root)
    if project_type(root) == "spm":
        found = [root / ".build/index/store"]
    else:
        derived = (Path.home() if home is None else Path(home)) / "Library/Developer/Xcode/DerivedData"
        folders = sorted(f for f in derived.glob("*") if f.name.startswith(root.resolve().name)) if derived.is_dir() else []
        found = [f / store for f in folders for store in ("Index.noindex/DataStore", "Index/DataStore")]
    return next((f for f in found if f.is_dir()), None)
