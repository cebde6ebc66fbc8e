"""Run configuration: sections of fields with a JSON form."""

from __future__ import annotations

import json
from dataclasses import asdict, field, make_dataclass

from .sources.files import DEFAULT_PATTERNS, discover_structure_files, make_folder, read_text, write_text

# Sections, fields and defaults of the configuration file.
FIELDS = {
    "inputs": {
        "roots": [],
        "patterns": DEFAULT_PATTERNS,
        "recursive": True,
        "file_selection_mode": "all",
        "random_file_count": None,
        "file_stride": None,
        "selection_seed": 0,
        "frame_stride": 1,
    },
    "soap": {
        "periodic": True,
        "r_cut": 6.0,
        "n_max": 4,
        "l_max": 4,
        "sigma": 1.0,
        "compression_mode": "mu2",
        "species": [],
    },
    "paths": {"desc_dir": "desc", "embedding_dir": "embedding", "selected_dir": "selected"},
}
DEFAULT_NAME = "workflow"


def _default(value):
    if isinstance(value, list):
        return field(default_factory=lambda: [*value])
    return field(default=value)


def _section(title: str, section: str, **methods):
    """Dataclass of one section of ``FIELDS``; its module is named, so that it can be pickled."""
    made = make_dataclass(
        title, [(name, object, _default(value)) for name, value in FIELDS[section].items()], namespace=methods
    )
    made.__module__ = __name__
    return made


def as_fields(config) -> dict:
    """Field values of a configuration object; a dict is one already."""
    return config if isinstance(config, dict) else asdict(config)


def _files(self, spark):
    return discover_structure_files(spark, self.roots, self.patterns, self.recursive)


def _soap_arguments(self) -> dict:
    values = as_fields(self)
    mode = values.pop("compression_mode")
    return values | ({"compression": {"mode": mode}} if mode else {})


def _folders(self) -> dict:
    """The folders of the run, made where they are missing."""
    return {name: make_folder(path) for name, path in as_fields(self).items()}


InputConfig = _section("InputConfig", "inputs", discover=_files)
SOAPConfig = _section("SOAPConfig", "soap", to_kwargs=_soap_arguments)
WorkflowPaths = _section("WorkflowPaths", "paths", resolve=_folders)
SECTIONS = {"inputs": InputConfig, "soap": SOAPConfig, "paths": WorkflowPaths}


def _one_pattern(sections: dict) -> None:
    """Files of an older form name a single pattern."""
    inputs = sections["inputs"]
    single = inputs.pop("pattern", None)
    if single is not None:
        inputs.setdefault("patterns", [single])


MIGRATIONS = [_one_pattern]


def _save(self, path: str) -> str:
    return write_text(path, json.dumps(as_fields(self), indent=2, sort_keys=True))


def _load(cls, path: str):
    stored = json.loads(read_text(path))
    sections = {name: dict(stored.get(name) or {}) for name in SECTIONS}
    for migrate in MIGRATIONS:
        migrate(sections)
    parts = {name: kind(**sections[name]) for name, kind in SECTIONS.items()}
    return cls(**parts, name=stored.get("name") or DEFAULT_NAME)


WorkflowConfig = make_dataclass(
    "WorkflowConfig",
    [*((name, kind, field(default_factory=kind)) for name, kind in SECTIONS.items()), ("name", str, DEFAULT_NAME)],
    namespace={"to_dict": as_fields, "save": _save, "load": classmethod(_load)},
)
WorkflowConfig.__module__ = __name__
