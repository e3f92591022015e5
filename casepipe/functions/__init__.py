"""Column -> Column functions (scalar, JVM-side, codegen friendly)."""

from casepipe.functions.text import (  # noqa: F401
    case_name,
    citation_flag,
    citation_uri,
    fact_flag,
    model_text,
    normalise_label,
    page_number,
    paragraph_ok,
    render_prompt,
    starts_with_number,
    strip_ws,
    truncate,
)
from casepipe.functions.tags import (  # noqa: F401
    align_labels,
    argmax,
    sigmoid_threshold,
    tag_id,
    tag_name,
)
