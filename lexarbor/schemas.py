"""Declared schemas of all inputs, as DDL: nothing is inferred."""

TARGET = "name string, entity string, topic_id long, limit long"
RAW_MESSAGE = "id long, url string, date string, text variant, _corrupt_record string"
POST = "channel string, url string, text string"
LABELLED = "text string, label string, url string"
TOKENS = "prompt_tokens long, completion_tokens long, total_tokens long"
GENERATED = (
    "label string, model string, temperature double, latency_sec double, text_length_chars long, tokens struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>,"
    " thought_process string, prompt string, text string, timestamp string"
)
#: A report maps labels to measures, and `accuracy` to a number: read values with readers.report_value().
REPORT = "variant"
EXPERIMENT = (
    "metadata struct<timestamp:string,tapt_enabled:boolean,aug_enabled:boolean,seeds_used:array<long>,train_size:long,test_size:long,aug_size:long>,"
    f" runs array<struct<seed:long,golden_classification_report:{REPORT},golden_confusion_matrix:array<array<long>>,"
    f"learning_curve:array<struct<epoch:long,train_loss:double,val_loss:double,val_macro_f1:double,learning_rate:double>>,aug_classification_report:{REPORT},aug_confusion_matrix:array<array<long>>>>"
)
CARTOGRAPHY = "map<string,struct<history:array<double>>>"
PRICES = "model string, `in` double, `out` double"
WEIGHTS = "model string, weight double"

#: Label codes; the two orders are both in use, so code is always by name.
LABEL_CODES = {"junk": 0, "single": 1, "listing": 2}
REPORT_ORDER = ["single", "listing", "junk"]
