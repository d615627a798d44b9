"""Schemas of the tables that operators exchange."""

from __future__ import annotations

FILES = """
repo_root STRING, path STRING, name STRING, type STRING,
exports ARRAY<STRING>, imports ARRAY<STRING>, classes ARRAY<STRING>, functions ARRAY<STRING>,
interfaces ARRAY<STRING>, keywords ARRAY<STRING>,
selectors ARRAY<STRUCT<attr:STRING,value:STRING>>, jsx_text ARRAY<STRING>, translation_keys ARRAY<STRING>,
routes ARRAY<STRUCT<path:STRING,component:STRING,component_path:STRING,is_lazy:BOOLEAN,is_dynamic:BOOLEAN>>,
redux STRUCT<selectors_used:ARRAY<STRING>,actions_dispatched:ARRAY<STRING>,slices_defined:ARRAY<STRING>>,
action_types ARRAY<STRING>, action_type_consts MAP<STRING,STRING>,
imported_idents ARRAY<STRUCT<name:STRING,module:STRING>>,
cypress STRUCT<visited_routes:ARRAY<STRING>, selectors:ARRAY<STRUCT<type:STRING,value:STRING,raw:STRING>>,
  contains_text:ARRAY<STRING>, intercepts:ARRAY<STRUCT<method:STRING,url_pattern:STRING>>,
  url_assertions:ARRAY<STRUCT<operator:STRING,expected:STRING>>, custom_commands:ARRAY<STRING>,
  describes:ARRAY<STRING>, its:ARRAY<STRING>>
"""
#: Evidence that a changed file and a test belong together; only matches have a row.
SIGNALS = "changed STRING, test STRING, type STRING, weight DOUBLE, anchor_eligible BOOLEAN, reason STRING"
#: Commits by file: seconds since 1970, and how many files the commit touched.
COMMITS = "repo STRING, path STRING, ts BIGINT, size INT"
#: Parts of slices of shared state: who plays which role in which slice.
CHAINS = "slice STRING, role STRING, path STRING"
#: What people decided on pairs before: state is 'confirmed' or 'rejected'.
LOCK = "changed STRING, test STRING, state STRING, reason STRING, confirmed_at DATE"
EDGES = "src STRING, dst STRING"
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
