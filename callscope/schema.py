"""Tables of a source graph and their columns.

Every table carries ``repo_name`` (owner/repository) and every query filters or joins on
it.  Node and edge tables hold only narrow columns but for ``functions``, whose
``raw_code`` and ``embedding`` no bulk query reads.
"""

from __future__ import annotations

CALL_SITE = "struct<name:string,syntax:string,start_line:int,end_line:int,start_column:int,end_column:int,resolution:string>"
FUNCTION_RECORD = (
    "struct<name:string,qualified_name:string,file_path:string,language:string,repository:string,signature:string,has_body:boolean,"
    "start_line:int,end_line:int,start_column:int,end_column:int,raw_code:string,definition_discriminator:string,entity_id:string,"
    f"calls:array<{CALL_SITE}>>"
)
PARSED_FILE = (
    "file_path string, repository string, source_tokens int, defined_classes array<string>, defined_functions array<string>, "
    f"outgoing_calls array<string>, functions array<{FUNCTION_RECORD}>, unattributed_calls array<{CALL_SITE}>"
)
TABLES = {
    "repositories": "repo_name string, name string, total_tokens bigint, tokenizer_model string, tokens_updated_at timestamp",
    "files": "repo_name string, path string, updated_at timestamp",
    "functions": (
        "repo_name string, entity_id string, name string, qualified_name string, file_path string, language string, signature string, "
        "definition_discriminator string, start_line int, end_line int, start_column int, end_column int, raw_code string, "
        "ambiguous_calls array<string>, embedding array<float>, leiden_community bigint"
    ),
    "external_functions": "repo_name string, name string",
    "calls": "repo_name string, caller_id string, target_kind string, target_key string, resolution string, call_count bigint, source_file string",
    "communities": "repo_name string, community_id bigint, name string, description string",
}
PUSH_EVENT = (
    "pushed_at timestamp, before string, after string, size int, forced boolean, created boolean, deleted boolean, "
    "commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>, "
    "repository struct<name:string,full_name:string,owner:struct<login:string,name:string>>"
)
#: Kinds of a call's target.
FUNCTION, EXTERNAL = "Function", "ExternalFunction"
UNGROUPED_ID, UNGROUPED_NAME = -1, "Ungrouped"
UNGROUPED_DESCRIPTION = "Functions in communities too small to describe."
MIN_LABELED_COMMUNITY = 3
