"""Fixed word lists used to classify SQL tokens."""

# Words that are never a column, table or alias name when unquoted.
RESERVED = [
    "SELECT", "FROM", "WHERE", "GROUP", "BY", "HAVING", "ORDER", "LIMIT", "OFFSET", "FETCH",
    "WINDOW", "QUALIFY", "UNION", "INTERSECT", "EXCEPT", "MINUS", "ALL", "DISTINCT", "TOP",
    "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "NATURAL", "SEMI", "ANTI",
    "LATERAL", "ON", "USING", "AS", "AND", "OR", "NOT", "IN", "IS", "LIKE", "ILIKE", "RLIKE",
    "REGEXP", "SIMILAR", "BETWEEN", "EXISTS", "ANY", "SOME", "ESCAPE", "COLLATE", "AT",
    "CASE", "WHEN", "THEN", "ELSE", "END", "NULL", "TRUE", "FALSE", "INTERVAL",
    "CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "LOCALTIME", "LOCALTIMESTAMP",
    "WITH", "RECURSIVE", "VALUES", "INSERT", "INTO", "UPDATE", "SET", "DELETE", "RETURNING",
    "CREATE", "ALTER", "DROP", "TRUNCATE", "TABLE", "VIEW", "INDEX", "MERGE", "FOR",
    "OVER", "PARTITION", "ASC", "DESC", "TABLESAMPLE", "PIVOT", "UNPIVOT",
]

# Reserved words that are names where an operand is expected, and what may stand before one.
SOMETIMES_NAMES = ["INDEX", "VIEW", "SET", "PARTITION"]
BEFORE_OPERAND = [
    "SELECT", "DISTINCT", "WHERE", "AND", "OR", "NOT", "ON", "BY", "HAVING", "CASE", "WHEN", "THEN",
    "ELSE", "BETWEEN", ",", "(", "=", "==", "<>", "!=", "<", "<=", ">", ">=", "+", "-", "*", "/", "%", "||",
]

# Words that may start a statement; an opening parenthesis may too.
STATEMENT_VERBS = [
    "SELECT", "WITH", "VALUES", "TABLE", "(",
    "INSERT", "UPDATE", "DELETE", "MERGE", "REPLACE", "COPY",
    "CREATE", "ALTER", "DROP", "TRUNCATE", "COMMENT", "ANALYZE", "VACUUM", "OPTIMIZE",
    "GRANT", "REVOKE", "BEGIN", "START", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE", "END",
    "SET", "RESET", "USE", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "PRAGMA",
    "CALL", "EXECUTE", "EXEC", "PREPARE", "DEALLOCATE", "DECLARE", "FETCH", "CLOSE",
    "CACHE", "UNCACHE", "REFRESH", "LOCK", "UNLOCK", "KILL", "ATTACH", "DETACH",
]

# The words the lower-case style rule looks for.
CASE_STYLE_WORDS = [
    "select", "from", "where", "join", "on", "group", "order", "having", "limit",
    "insert", "update", "delete", "create", "drop", "truncate", "union", "distinct",
]

SET_OPERATORS = ["UNION", "INTERSECT", "EXCEPT", "MINUS"]
COMPARISONS = ["=", "==", "<>", "!=", "<", "<=", ">", ">="]
ARITHMETIC = ["+", "-", "*", "/", "%"]
# An operator right after an operand that pulls the operand into a longer expression.
BINDING_AFTER = ARITHMETIC + ["||", "::", "->", "->>", "^", "&", "|", "(", "[", "COLLATE", "AT"]
# An operator right before an operand that does the same.
BINDING_BEFORE = ARITHMETIC + COMPARISONS + ["||", "::", "->", "->>", "^", "&", "|", "~"]
# Predicates whose operands are not examined further.
OPAQUE_PREDICATES = ["LIKE", "ILIKE", "RLIKE", "REGEXP", "SIMILAR", "BETWEEN", "IN", "IS"]
# Call-like syntax with its own grammar: the inside is not an argument list.
OPAQUE_CALLS = [
    "CAST", "TRY_CAST", "SAFE_CAST", "CONVERT", "EXTRACT", "TRIM", "SUBSTRING", "POSITION",
    "OVERLAY", "CEIL", "FLOOR", "IN", "OVER", "USING", "ANY", "ALL", "SOME", "EXISTS", "VALUES",
    "CUBE", "ROLLUP", "SETS",
]
# Those after which an opening parenthesis follows without a blank when a text is printed again.
CALL_PRINTED = [
    "CAST", "TRY_CAST", "SAFE_CAST", "CONVERT", "EXTRACT", "TRIM", "SUBSTRING", "POSITION",
    "OVERLAY", "CEIL", "FLOOR",
]
# Words that begin the main part of a statement after its WITH list.
MAIN_VERBS = ["SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "VALUES", "TABLE"]
# Reserved words that are functions when a parenthesis follows.
FUNCTION_WORDS = ["LEFT", "RIGHT"]
JOIN_MODIFIERS = ["INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "NATURAL", "SEMI", "ANTI"]
# Words that end one operand and begin another part of the statement.
PART_WORDS = [
    "SELECT", "DISTINCT", "FROM", "WHERE", "GROUP", "BY", "HAVING", "ORDER", "LIMIT", "OFFSET",
    "FETCH", "WINDOW", "QUALIFY", "UNION", "INTERSECT", "EXCEPT", "MINUS", "JOIN", "ON", "USING",
    "SET", "VALUES", "RETURNING", "WITH", "AS", "CASE", "WHEN", "THEN", "ELSE", "END", "OR",
    "ASC", "DESC",
]
# Words that can follow a complete join condition.
AFTER_CONDITION = [
    ")", ";", ",", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "FETCH", "UNION",
    "INTERSECT", "EXCEPT", "MINUS", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL",
    "WINDOW", "QUALIFY", "FOR",
]
# Words besides those of PART_WORDS that no operand reaches across.
SLICE_ENDS = [";", "FOR", "CROSS", "NATURAL", "INNER", "FULL", "OUTER", "PARTITION", "OVER", "INTO"]
# Clause words whose label is the word itself.
OTHER_CLAUSES = [
    "WHERE", "HAVING", "LIMIT", "OFFSET", "FETCH", "WINDOW", "QUALIFY", "SET", "VALUES",
    "RETURNING", "INTO", "FOR",
]
# Words that cannot be the last token of a statement.
DANGLING = [
    "SELECT", "FROM", "WHERE", "GROUP", "BY", "HAVING", "ORDER", "JOIN", "ON", "AND", "OR",
    "NOT", "IN", "LIKE", "BETWEEN", "UNION", "INTERSECT", "EXCEPT", "SET", "WITH", "AS", ",",
    "=", "<>", "!=", "<", "<=", ">", ">=", "+", "/", "||",
]

# Type names compared by the type-mismatch rule.
NUMERIC_TYPES = [
    "int", "integer", "smallint", "bigint", "tinyint", "decimal", "float", "double", "real",
]
STRING_TYPES = ["varchar", "char", "text", "string"]
