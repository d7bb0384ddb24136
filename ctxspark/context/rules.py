"""Fixed values of the conversation memory: labels, entities, tags, extraction markers, schemas."""

AGENT_INTERNAL, CONFIDENTIAL, TOOL_TRACE = "AGENT_INTERNAL", "CONFIDENTIAL_CUSTOMER_DATA", "TOOL_TRACE"
REDACTED = f"[redacted:{CONFIDENTIAL}]"

CONFIDENTIAL_TERMS = ("password", "secret", "api key", "api token", "access token", "auth token", "bearer token", "refresh token", "session token", "credential token", "ssn", "social security", "credit card", "confidential", "private key")
TOOL_TERMS = ("tool call", "tool trace", "stack trace")
#: Terms that make a constraint one of security.
SECURITY_TERMS = ("password", "secret", "api key", "api token", "access token", "bearer token", "private key", "credit card", "ssn")

#: entity: (substrings, whole words)
ENTITIES = (
    ("dog", (), ("dog", "puppy", "pet")),
    ("sqlite", ("sqlite", "sql", "b-tree", "btree"), ()),
    ("performance", ("benchmark", "perf", "slow", "latency"), ()),
    ("storage-safety", ("wal", "lock", "recovery", "transaction"), ()),
    ("docs", ("readme", "docs", "documentation"), ()),
    ("ml-dataset", ("pytorch", "torch", "dataset", "training"), ()),
)

#: tag, score, reason, substrings, whole words
TAGS = (
    ("convo about dog", 90, "matched pet/dog term", (), ("dog", "puppy", "pet")),
    ("debugging sqlite perf", 85, "matched sql/sqlite/join term", ("sqlite", "b-tree", "btree"), ("sql", "join")),
    ("benchmarks", 82, "matched benchmark metric term", ("benchmark", "recall", "avg tokens", "average tokens"), ()),
    ("memory baselines", 80, "matched memory baseline term", ("mem0", "rag", "recency-window"), ()),
    ("agent integration", 78, "matched agent/context term", ("agent", "context pack", "current_context", "dogfood", "helper"), ()),
    ("project roadmap", 76, "matched project planning term", ("roadmap", "next step", "project"), ()),
    ("docs", 74, "matched docs/readme term", ("readme", "docs", "documentation"), ()),
    ("debug this later", 95, "matched follow-up marker", ("debug this later", "investigate", "look into"), ()),
    ("open questions", 92, "contains question mark", ("?",), ()),
    ("constraints", 88, "matched constraint marker", ("remember that", "always ", "never ", "don't ", "do not "), ()),
    ("preferences", 86, "matched preference marker", ("i like ", "i prefer "), ()),
    ("current tasks", 89, "matched task marker", ("i need ", "i want ", "todo"), ()),
)
FALLBACK_TAG = ("main", 1, "fallback")

#: key, type, markers (the first that gives a value wins), whether the value starts with the marker
MARKERS = (
    ("user_location", "fact", ("i live in ", "i moved to ", "moved to ", "i am in ", "i'm in ", "my location is ", "i live near "), False),
    ("user_preference", "preference", ("i prefer ", "i like "), False),
    ("dog_preference", "preference", ("my dog likes ", "my dog loves ", "my dog prefers "), False),
    ("dog_name", "fact", ("my dog is named ", "my dog's name is "), False),
    ("user_constraint", "constraint", ("remember that ",), False),
    ("user_constraint", "constraint", ("always ", "never ", "do not ", "don't "), True),
    ("current_task", "task", ("i need ", "i want "), False),
    ("debug_followup", "debug", ("todo: ", "todo ", "debug this later: ", "investigate ", "look into "), False),
    ("decision", "decision", ("we decided ", "decision: ", "final call: "), False),
)
#: The one rule label that drops its marker's last space.
BARE_RULES = {"remember that ": "marker:remember that"}
SLUGGED = ("decision", "open_question", "debug_followup", "current_task", "user_constraint")

STORAGE_ROUTE = "structured=catalog.contexts.messages; vector=ConversationMessage.content; blob=none"
ATOM_ROUTE = "structured=catalog.contexts.atoms"
VIEW_ROUTE = "structured=catalog.contexts.messages+atoms; vector=ConversationMessage.content; blob=tool/object refs"
REGISTRY = "CSR: ConversationMessage.v1 + ContextAtom.v1"

#: schema, version, owner, sensitivity, retention, storage, vectorized fields, access labels, indexed fields, related
SCHEMAS = (
    ("ConversationMessage", "v1", "system", "agent-internal", "conversation-lifetime", "structured+vector", "content", "AGENT_INTERNAL", "conversation_id,sender_id,sender_type,timestamp,tab,mentioned_entities,access_labels,schema_name,storage_route", "ContextAtom,TaskState,ToolInvocationLog"),
    ("ContextAtom", "v1", "system", "agent-internal", "conversation-lifetime", "structured", "", "AGENT_INTERNAL", "key,type,status,tab,source,invalidated_by,access_labels,schema_name", "ConversationMessage"),
    ("TaskState", "v1", "system", "agent-internal", "task-lifetime", "structured", "description", "AGENT_INTERNAL", "task_id,status,assigned_agent_id,last_update_timestamp", "ConversationMessage,ToolInvocationLog"),
    ("ToolInvocationLog", "v1", "system", "agent-internal", "audit-lifetime", "structured+blob", "summary", "AGENT_INTERNAL,TOOL_TRACE", "tool_id,conversation_id,message_id,status,timestamp", "ConversationMessage,TaskState"),
    ("UserProfile", "v1", "system", "confidential", "user-lifetime", "structured", "preferences", "CONFIDENTIAL_CUSTOMER_DATA", "user_id,tenant_id,access_labels", "ConversationMessage"),
)
SCHEMA_COLUMNS = ("schema", "version", "owner_agent", "sensitivity", "retention", "storage", "vectorized_fields", "access_labels", "indexed_fields", "related_schemas")

#: Query terms that lift a kind of atom: (what it lifts, query terms, value terms, points)
LOCATION_QUERY = ("near me", "nearby", "restaurant", "weather", "location", "near ")
PREFERENCE_QUERY = ("recommend", "choose", "prefer")
FOOD_QUERY, FOOD_VALUE = ("restaurant", "cafe", "food", "dinner", "lunch"), ("restaurant", "cafe", "food", "quiet", "coffee")
QUESTION_QUERY, DEBUG_QUERY = ("question", "open", "?"), ("debug", "todo", "investigate")
