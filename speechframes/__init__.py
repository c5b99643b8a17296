"""speechframes: speech-session analytics as Spark DataFrame plans."""
