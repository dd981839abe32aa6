"""factloom: a Spark-native engine that turns page text into evidence-backed facts and answers queries over them."""
