"""Schemas of the relations; all are keyed by pair_id, most also by side (before, after)."""

from __future__ import annotations

FILES = "pair_id string, side string, path string, size long, sha256 string, mode int, mode_known boolean, kind string, content binary, probe binary"
_MAP = "map<string,string>"
PACKAGES = (
    "pair_id string, side string, source_kind string, resolved string, integrity string, attestations boolean, signatures boolean, source_maintainers array<string>, "
    f"name string, version string, description string, license string, repository string, engines {_MAP}, scripts {_MAP}, dependencies {_MAP}, optional_dependencies {_MAP}, "
    f"peer_dependencies {_MAP}, dev_dependencies {_MAP}, bundled array<string>, maintainers array<string>, entry_points array<string>, files array<string>"
)
EVIDENCE = "struct<file:string,line:int,message:string,snippet:string>"
DRAFTS = f"pair_id string, draft_ord int, draft_sub string, id string, identity string, category string, severity string, score int, evidence array<{EVIDENCE}>, tags array<string>"
PROFILES = f"sha256 string, ext string, signals array<struct<capability:string,line:int,message:string,snippet:string>>, hosts array<struct<host:string,line:int,snippet:string>>, gaps array<struct<reason:string,detail:string>>"
