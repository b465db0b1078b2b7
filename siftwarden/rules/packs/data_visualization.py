"""Chart code."""

CATEGORY = "data_visualization"
SUBJECT = "chart setting"

# Name, severity, confidence and pattern of each rule, with entropy floor and scope, decide what is
# reported.  They stand as published, in their order.
RULES = [
    ("chart-accessibility", "medium", "high", r"canvas[^>]*[^aria-]|tooltip.*enabled.*false|legend.*display.*false"),
    ("chart-config", "medium", "high",
     r"Chart\.js.*type.*bar.*data.*1000\+|options.*responsive.*false|scale.*ticks.*display.*false"),
    ("chart-types", "medium", "high", r"type.*bar.*data.*1000\+|type.*line.*categories.*10\+|type.*pie.*slices.*20\+"),
    ("color-schemes", "medium", "high", r"backgroundColor.*#[fF]{6}|borderColor.*#[0F]{6}|color.*palette.*contrast"),
    ("mobile-optimization", "medium", "high", r"responsive.*false|width.*100%.*height.*100%|chart.*mobile.*breakpoint"),
]
