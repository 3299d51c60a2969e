"""Small fixed dimensions: rules and their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rule id, severity, category.
RULES = [
    ("L001", "warning", "performance"),
    ("L002", "error", "safety"),
    ("L003", "warning", "performance"),
    ("L004", "info", "style"),
    ("L005", "warning", "performance"),
    ("L006", "info", "performance"),
    ("L007", "error", "safety"),
    ("L008", "warning", "performance"),
    ("L009", "info", "style"),
    ("L010", "warning", "performance"),
    ("L011", "info", "performance"),
    ("L012", "warning", "performance"),
    ("L013", "warning", "performance"),
    ("L014", "warning", "safety"),
    ("L015", "error", "safety"),
    ("L016", "error", "safety"),
    ("L017", "warning", "style"),
    ("L018", "info", "style"),
    ("L019", "error", "safety"),
    ("L020", "error", "safety"),
    ("L021", "warning", "performance"),
    ("L022", "info", "performance"),
    ("L023", "warning", "safety"),
    ("L024", "warning", "performance"),
    ("L025", "info", "style"),
    ("L026", "warning", "performance"),
]
RULE_IDS = [r[0] for r in RULES]

# Display names of severities and categories by language.
LABELS = [
    ("severity", "error", "en", "Error"),
    ("severity", "error", "tr", "Hata"),
    ("severity", "warning", "en", "Warning"),
    ("severity", "warning", "tr", "Uyarı"),
    ("severity", "info", "en", "Info"),
    ("severity", "info", "tr", "Bilgi"),
    ("category", "performance", "en", "Performance"),
    ("category", "performance", "tr", "Performans"),
    ("category", "safety", "en", "Safety"),
    ("category", "safety", "tr", "Güvenlik"),
    ("category", "style", "en", "Style"),
    ("category", "style", "tr", "Stil"),
]

# rule, variant, English message, English advice, Turkish message, Turkish advice
MESSAGES = [
    ("L001", "", "All columns are read with *.", "Name the columns you need.",
     "Tüm sütunlar * ile okunuyor.", "Gereken sütunları adıyla yazın."),
    ("L002", "UPDATE", "UPDATE has no WHERE: every row changes.", "Add a WHERE condition.",
     "UPDATE için WHERE yok: her satır değişir.", "WHERE koşulu ekleyin."),
    ("L002", "DELETE", "DELETE has no WHERE: every row is removed.", "Add a WHERE condition.",
     "DELETE için WHERE yok: her satır silinir.", "WHERE koşulu ekleyin."),
    ("L003", "", "OR in a condition can keep an index from being used.",
     "Consider one query per branch, joined by UNION ALL.",
     "Koşuldaki OR dizin kullanımını önleyebilir.", "Dalları UNION ALL ile birleştirmeyi düşünün."),
    ("L004", "", "Keywords are written in lower case.", "Write keywords in upper case.",
     "Anahtar sözcükler küçük harfle yazılmış.", "Anahtar sözcükleri büyük harfle yazın."),
    ("L005", "", "The LIKE pattern starts with a wildcard: a full scan is needed.",
     "Anchor the pattern at its start or use full-text search.",
     "LIKE kalıbı joker ile başlıyor: tam tarama gerekir.", "Kalıbı başından sabitleyin."),
    ("L006", "", "DISTINCT can need a sort or a shuffle of all rows.", "Check that it is needed.",
     "DISTINCT tüm satırların sıralanmasını gerektirebilir.", "Gerekli olduğunu denetleyin."),
    ("L007", "DROP", "DROP TABLE cannot be undone.", "Back the table up first.",
     "DROP TABLE geri alınamaz.", "Önce tabloyu yedekleyin."),
    ("L007", "TRUNCATE", "TRUNCATE cannot be undone.", "Delete only the rows meant.",
     "TRUNCATE geri alınamaz.", "Yalnızca istenen satırları silin."),
    ("L008", "", "NOT IN with a subquery matches nothing once a NULL appears.", "Use NOT EXISTS.",
     "Alt sorgulu NOT IN, NULL varsa hiçbir satır döndürmez.", "NOT EXISTS kullanın."),
    ("L009", "", "Joined table '{1}' has no alias.", "Give it one, such as {1} {2}.",
     "Birleştirilen '{1}' tablosunun takma adı yok.", "Bir takma ad verin: {1} {2}."),
    ("L010", "", "A scalar subquery in a condition can run once per row.", "Use a join or a CTE.",
     "Koşuldaki skaler alt sorgu her satır için çalışabilir.", "JOIN veya CTE kullanın."),
    ("L011", "", "UNION removes duplicates at a cost.", "Use UNION ALL if duplicates may stay.",
     "UNION yinelenenleri maliyetle eler.", "Yinelenenler kalabilirse UNION ALL kullanın."),
    ("L012", "math", "Arithmetic on a column in a filter hides it from indexes.",
     "Move the arithmetic to the other side.",
     "Filtrede sütun üzerinde aritmetik dizini devre dışı bırakır.", "Aritmetiği öbür tarafa taşıyın."),
    ("L012", "call", "A function on a column in a filter hides it from indexes.",
     "Compare the bare column.",
     "Filtrede sütun üzerinde işlev dizini devre dışı bırakır.", "Sütunu yalın karşılaştırın."),
    ("L013", "", "DISTINCT adds nothing to GROUP BY.", "Remove DISTINCT.",
     "GROUP BY varken DISTINCT gereksizdir.", "DISTINCT sözcüğünü kaldırın."),
    ("L014", "", "HAVING without GROUP BY is usually a mistake.", "Use WHERE or add GROUP BY.",
     "GROUP BY olmadan HAVING genellikle hatadır.", "WHERE kullanın ya da GROUP BY ekleyin."),
    ("L015", "", "A column is compared with itself.", "Check which column was meant.",
     "Bir sütun kendisiyle karşılaştırılıyor.", "Hangi sütunun istendiğini denetleyin."),
    ("L016", "", "A join has no real condition: every pair of rows results.", "Add a join condition.",
     "JOIN koşulu eksik ya da sabit: her satır çifti üretilir.", "Bir birleştirme koşulu ekleyin."),
    ("L017", "", "ORDER BY uses a column number.", "Write the column name.",
     "ORDER BY sütun numarası kullanıyor.", "Sütun adını yazın."),
    ("L018", "", "Tables are joined by commas.", "Write an explicit JOIN.",
     "Tablolar virgülle birleştirilmiş.", "Açık JOIN yazın."),
    ("L019", "from", "A subquery in FROM has no alias.", "Name it.",
     "FROM içindeki alt sorgunun takma adı yok.", "Bir ad verin."),
    ("L019", "join", "A subquery in JOIN has no alias.", "Name it.",
     "JOIN içindeki alt sorgunun takma adı yok.", "Bir ad verin."),
    ("L020", "table", "Table not found: '{1}'.", "Check the spelling or update the catalog.",
     "Tablo bulunamadı: '{1}'.", "Yazımı denetleyin ya da kataloğu güncelleyin."),
    ("L020", "alias", "Unknown table or alias: '{1}'.", "No source of the query has this name.",
     "Bilinmeyen tablo ya da takma ad: '{1}'.", "Sorguda bu adda kaynak yok."),
    ("L020", "column", "Column not found: '{1}'.", "No table of the query has this column.",
     "Sütun bulunamadı: '{1}'.", "Sorgu tablolarında bu sütun yok."),
    ("L020", "ambiguous", "Ambiguous column: '{1}'.", "It exists in {2}; qualify it.",
     "Belirsiz sütun: '{1}'.", "Şuralarda var: {2}; nitelendirin."),
    ("L021", "numeric", "Types differ: numeric column '{1}' is compared with a string.",
     "Compare with a number.",
     "Tür uyuşmazlığı: sayısal '{1}' sütunu metinle karşılaştırılıyor.", "Sayıyla karşılaştırın."),
    ("L021", "string", "Types differ: text column '{1}' is compared with a number.",
     "Compare with a string.",
     "Tür uyuşmazlığı: metinsel '{1}' sütunu sayıyla karşılaştırılıyor.", "Metinle karşılaştırın."),
    ("L022", "", "Filter on unindexed column '{2}.{1}'.", "Index it or filter on a key column.",
     "Dizinsiz sütunda filtre: '{2}.{1}'.", "Dizin ekleyin ya da anahtar sütunla süzün."),
    ("L023", "", "= NULL is never true.", "Use IS NULL or IS NOT NULL.",
     "= NULL hiçbir zaman doğru olmaz.", "IS NULL veya IS NOT NULL kullanın."),
    ("L024", "", "A scalar subquery in the select list can run once per row.", "Use a LEFT JOIN.",
     "SELECT listesindeki skaler alt sorgu her satır için çalışabilir.", "LEFT JOIN kullanın."),
    ("L025", "", "Doubled parentheses.", "Remove one pair.", "Çift parantez.", "Bir çiftini kaldırın."),
    ("L026", "", "The query has no LIMIT.", "Bound the result or page through it.",
     "Sorguda LIMIT yok.", "Sonucu sınırlayın ya da sayfalayın."),
]


def rule_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, severity string, category string")


def label_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "kind string, code string, lang string, label string")


def message_dim(spark: SparkSession) -> DataFrame:
    rows = [(r, v, "en", em, ea) for r, v, em, ea, _, _ in MESSAGES]
    rows += [(r, v, "tr", tm, ta) for r, v, _, _, tm, ta in MESSAGES]
    return spark.createDataFrame(
        rows, "rule_id string, variant string, lang string, message_tpl string, advice_tpl string"
    )
