"""DuckDB SQL that gives the same rows as the queries over arriving tables."""

from __future__ import annotations

from dossier.plans.sql_retrieval import KB
from dossier.plans.sql_text import ORACLES as TEXT

ORACLES = {
    "stream_numbered_items": TEXT["numbered_items"],
    "staged_kb_refresh": f"""with {KB} select kb, doc_id, type, cast(case when kb = 'kb0' then 2 else 1 end as bigint) as version,
        case when kb = 'kb0' then reverse(document) else document end as document from kb""",
}
